"""Dictionaries and rule lists as input tables.

Every list an operator consults comes from a table supplied by the caller.  These lists are
settings, not data: they are read once, behind a checked bound, and enter the plan as literals,
so the big tables are neither joined nor shuffled to consult them.  A table beyond the bound is
refused, never cut; large dictionaries take ``operators.skills.scan_terms_by_join``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INLINE_ROWS = 5_000

SCHEMAS = {
    "skill": "term string, dictionary boolean, approved boolean, acronym boolean, single_letter boolean",
    "alias": "variant string, canonical string",
    "stop": "term string, kind string",
    "display": "term string, display_name string",
    "role_kw": "role string, pos int, keyword string",
    "industry_rule": "label string, priority int, keyword string",
    "quality_rule": "kind string, pattern string",
    "keyword_rule": "set_id int, kind string, pattern string",
    "stopword": "word string",
}

SEED_DIR = Path(__file__).parent / "seed"

_ITEM, _PAIR = "\u0001", "\u0002"


def array_literal(items: Iterable[str]) -> Column:
    """One array<string> literal; a single expression however long the list is."""
    items = list(items)
    if not items:
        return F.array().cast("array<string>")
    return F.split(F.lit(_ITEM.join(items)), _ITEM)


def one_of(col: Column, items: Iterable[str]) -> Column:
    """Membership in a fixed list, as a hashed set test."""
    items = sorted(items)
    return col.isin(items) if items else F.lit(False)


def map_literal(pairs: Mapping[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    text = _ITEM.join(f"{k}{_PAIR}{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit(_ITEM), F.lit(_PAIR))


def bounded_rows(df: DataFrame, max_rows: int = MAX_INLINE_ROWS) -> list:
    """Rows of a settings table; refuses a table beyond the bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"settings table has more than {max_rows} rows: {df.columns}")
    return rows


@dataclass(frozen=True)
class KeywordSet:
    include: tuple[str, ...]
    exclude: tuple[str, ...]


@dataclass(frozen=True)
class Vocabulary:
    dictionary: frozenset[str] = frozenset()
    approved: frozenset[str] = frozenset()
    acronyms: frozenset[str] = frozenset()
    single_letters: frozenset[str] = frozenset()
    aliases: Mapping[str, str] = field(default_factory=dict)
    stops: Mapping[str, frozenset[str]] = field(default_factory=dict)
    displays: Mapping[str, str] = field(default_factory=dict)
    roles: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    industries: tuple[tuple[str, tuple[str, ...]], ...] = ()
    quality: Mapping[str, frozenset[str]] = field(default_factory=dict)
    keyword_sets: Mapping[int, KeywordSet] = field(default_factory=dict)
    stopwords: frozenset[str] = frozenset()

    @classmethod
    def from_tables(cls, tables: Mapping[str, DataFrame]) -> Vocabulary:
        """Build from tables shaped as in ``SCHEMAS``; a list that is not given is empty."""
        rows = {name: bounded_rows(tables[name]) if name in tables else [] for name in SCHEMAS}

        def flagged(flag):
            return frozenset(r["term"] for r in rows["skill"] if r[flag])

        def grouped(name, key, value):
            keys = {r[key] for r in rows[name]}
            return {k: frozenset(r[value] for r in rows[name] if r[key] == k) for k in keys}

        roles: dict[str, list[str]] = {}
        for r in sorted(rows["role_kw"], key=lambda r: (r["role"], r["pos"])):
            roles.setdefault(r["role"], []).append(r["keyword"])
        industries: dict[tuple[int, str], list[str]] = {}
        for r in sorted(rows["industry_rule"], key=lambda r: (r["priority"], r["label"])):
            industries.setdefault((r["priority"], r["label"]), []).append(r["keyword"])
        sets: dict[int, dict[str, list[str]]] = {}
        for r in rows["keyword_rule"]:
            sets.setdefault(r["set_id"], {"include": [], "exclude": []})[r["kind"]].append(r["pattern"])
        return cls(
            dictionary=flagged("dictionary"),
            approved=flagged("approved"),
            acronyms=flagged("acronym"),
            single_letters=flagged("single_letter"),
            aliases={r["variant"]: r["canonical"] for r in rows["alias"]},
            stops=grouped("stop", "kind", "term"),
            displays={r["term"]: r["display_name"] for r in rows["display"]},
            roles={k: tuple(v) for k, v in roles.items()},
            industries=tuple((label, tuple(kws)) for (_, label), kws in industries.items()),
            quality=grouped("quality_rule", "kind", "pattern"),
            keyword_sets={k: KeywordSet(tuple(v["include"]), tuple(v["exclude"])) for k, v in sets.items()},
            stopwords=frozenset(r["word"] for r in rows["stopword"]),
        )

    @classmethod
    def load(cls, spark: SparkSession, folder: str | Path | None = None) -> Vocabulary:
        """Read one CSV per list from a folder; the packaged seed lists by default."""
        base = str(folder or SEED_DIR)
        reader = spark.read.option("header", True).option("ignoreTrailingWhiteSpace", False)
        return cls.from_tables(
            {name: reader.schema(schema).csv(f"{base}/{name}.csv") for name, schema in SCHEMAS.items()}
        )

    @property
    def known(self) -> frozenset[str]:
        return self.dictionary | self.approved

    def stop(self, kind: str) -> frozenset[str]:
        return self.stops.get(kind, frozenset())

    def resolve(self, term: str) -> str:
        """One alias step."""
        return self.aliases.get(term, term)
