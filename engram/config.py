"""Configuration: TOML sections with defaults; unknown keys are ignored, wrong values are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

from .functions.segment import load as load_words
from .functions.stopwords import load
from .functions.text import Extraction
from .operators.rank import Ranking
from .schema import EngineError


@dataclass(frozen=True)
class Config:
    ranking: Ranking = Ranking()
    extraction: Extraction = field(default_factory=Extraction)
    auto_checkpoint: int = 1000
    max_content_len: int = 1 << 20
    query_cache: int = 256
    doc_cache: int = 128
    hot_preload: int = 32
    password_min_len: int = 8
    cell_max: int = 60
    max_rows: int = 50
    prompt: str = "engram> "
    server_addr: str = "127.0.0.1:7777"
    log_enabled: bool = True
    log_file: str = ""  # none: nothing is logged
    log_level: str = "info"
    log_max_size: int = 10 << 20


def _own(kind, section: dict, **names: str) -> dict:
    known = {f.name for f in fields(kind)}
    return {names.get(k, k): v for k, v in section.items() if names.get(k, k) in known}


def from_toml(text: str) -> Config:
    raw = tomllib.loads(text)
    engine = raw.get("engine", {})
    words = raw.get("tokenizer", {})
    extraction = replace(Extraction(), **{k: v for k, v in _own(Extraction, words).items() if k not in ("stopwords", "dictionary")})
    if "stopwords_file" in words:
        extraction = replace(extraction, stopwords=tuple(sorted(load(words["stopwords_file"]))))
    if "dictionary_file" in words:
        extraction = replace(extraction, dictionary=load_words(words["dictionary_file"]))
    ranking = replace(Ranking(), **_own(Ranking, engine.get("search", {}), expansion_decay="decay", default_limit="limit"))
    cache = engine.get("cache", {})
    plain = _own(Config, {k: v for k, v in engine.items() if not isinstance(v, dict)}) | {k: cache[s] for s, k in (("query", "query_cache"), ("doc", "doc_cache"), ("hot_preload", "hot_preload")) if s in cache}
    plain |= _own(Config, raw.get("cli", {})) | _own(Config, raw.get("auth", {})) | _own(Config, raw.get("server", {}), default_addr="server_addr")
    plain |= _own(Config, {f"log_{k}": v for k, v in raw.get("logging", {}).items()})
    return checked(Config(ranking, extraction, **plain))


def checked(c: Config) -> Config:
    r, e = c.ranking, c.extraction
    rules = {
        "search.k1": r.k1 > 0, "search.b": 0 <= r.b <= 1, "search.hops": 0 <= r.hops <= 2, "search.expansion_limit": r.expansion_limit >= 0,
        "search.expansion_decay": 0 <= r.decay <= 1, "search.similarity_weight": r.similarity_weight >= 0, "search.default_limit": r.limit > 0,
        "tokenizer.max_keywords": e.max_keywords > 0, "tokenizer.max_key_points": e.max_key_points >= 0, "tokenizer.min_keyword_len": e.min_keyword_len > 0,
        "engine.auto_checkpoint": c.auto_checkpoint > 0, "engine.max_content_len": c.max_content_len > 0, "cache.query": c.query_cache >= 0, "cache.doc": c.doc_cache >= 0,
        "logging.level": c.log_level in ("debug", "info", "warn", "error"), "logging.max_size": c.log_max_size > 0, "server.default_addr": c.server_addr.rpartition(":")[2].isdigit(),
    }
    if wrong := [k for k, ok in rules.items() if not ok]:
        raise EngineError(f"configuration out of range: {', '.join(wrong)}")
    return c
