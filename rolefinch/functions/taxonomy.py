"""Versioned regex taxonomies of skills."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .matcher import names_in

REVISION = 1
BUNDLED = Path(__file__).with_name("taxonomy.yaml")


class Pattern(NamedTuple):
    name: str
    category: str
    pattern: str
    case_sensitive: bool = False


class TaxonomyError(ValueError):
    pass


class Taxonomy:
    def __init__(self, patterns: list[Pattern], document: object = None):
        """``document`` is what the version is taken from: the whole file an own taxonomy was read from."""
        if not patterns:
            raise TaxonomyError("the taxonomy has no patterns")
        seen = set()
        for p in patterns:
            if not (p.name and p.category and p.pattern):
                raise TaxonomyError(f"{p.name or '?'}: name, category and pattern are required")
            if p.name in seen:
                raise TaxonomyError(f"{p.name}: listed twice")
            seen.add(p.name)
            try:
                re.compile(p.pattern)
            except re.error as e:
                raise TaxonomyError(f"{p.name}: {e}") from e
        self.patterns = patterns
        document = document or {"version": 1, "patterns": [p._asdict() for p in patterns]}
        canonical = json.dumps(document, sort_keys=True, separators=(",", ":"))
        self.version = hashlib.sha256(f"{canonical}|extractor_revision={REVISION}".encode()).hexdigest()

    def checked(self, spark: SparkSession) -> Taxonomy:
        """Itself, if Spark's regex dialect takes every pattern too; else an error that names the first it refuses."""
        try:
            spark.range(1).select(self.skills_by_rlike(F.lit("").alias("x"))).collect()
        except Exception:
            for p in self.patterns:
                try:
                    spark.range(1).select(F.concat(F.lit(""), F.col("id").cast("string")).rlike(f"(?U){p.pattern}")).collect()
                except Exception as e:
                    raise TaxonomyError(f"{p.name}: Spark does not take its pattern") from e
            raise
        return self

    def skills(self, text: Column) -> Column:
        """Names of the patterns that occur in the text, in code-point order; one pass over each text."""
        return F.pandas_udf(names_in(tuple((p.name, p.pattern, p.case_sensitive) for p in self.patterns)), "array<string>")(text)

    def skills_by_rlike(self, text: Column) -> Column:
        """The same by one ``rlike`` a pattern, within the JVM: for a few patterns that Spark's dialect takes."""
        hit = (F.when(text.rlike(f"(?{'' if p.case_sensitive else 'i'}U){p.pattern}"), p.name) for p in self.patterns)
        return F.array_sort(F.array_compact(F.array(*hit)))

    def categories(self, skills: Column) -> Column:
        of = F.create_map(*(F.lit(x) for p in self.patterns for x in (p.name, p.category)))
        return F.map_from_entries(F.transform(skills, lambda s: F.struct(s, of[s])))


def load(path: str | Path | None = None) -> Taxonomy:
    """The bundled taxonomy, or an own file that replaces it: YAML with a list ``patterns`` of mappings, or lines ``name <tab> category <tab> i or c <tab> pattern``."""
    source = Path(path) if path else BUNDLED
    out, document = [], None
    try:
        if source.suffix in (".yaml", ".yml"):
            import yaml

            try:
                document = yaml.safe_load(source.read_text(encoding="utf-8"))
            except yaml.YAMLError as e:
                raise TaxonomyError(str(e)) from e
            listed = document.get("patterns") if isinstance(document, dict) else None
            if not isinstance(listed, list):
                raise TaxonomyError("a list of patterns is required")
            for n, x in enumerate(listed, 1):
                if not isinstance(x, dict):
                    raise TaxonomyError(f"pattern {n}: a mapping is required")
                out.append(Pattern(*(x.get(k) or "" for k in ("name", "category", "pattern")), bool(x.get("case_sensitive", False))))
        else:
            for n, line in enumerate(source.read_text(encoding="utf-8").splitlines(), 1):
                if line and not line.startswith("#"):
                    parts = line.split("\t")
                    if len(parts) != 4 or parts[2] not in ("i", "c"):
                        raise TaxonomyError(f"line {n}: four fields are required")
                    out.append(Pattern(parts[0], parts[1], parts[3], parts[2] == "c"))
        return Taxonomy(out, document)
    except TaxonomyError as e:
        raise TaxonomyError(f"{source}: {e}") from e
