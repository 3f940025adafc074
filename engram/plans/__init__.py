"""The SQL dialect: lexer, syntax tree and parser."""
