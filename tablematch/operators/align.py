"""Column alignment and canonical mapping. Decisions are made on column names; only datatype validation reads data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablematch.config import (
    AMOUNT_WORDS, DEFAULTS, FIELD_VALIDATORS, IGNORE_MARKS, REPORT_AMOUNT_WORDS, Settings,
)
from tablematch.functions.text import contained_boost, flat_name, loose_name, name_ratio
from tablematch.functions.validate import validator_scores
from tablematch.functions.values import clean_amount, parse_date
from tablematch.operators.clean import data_columns, drop_empty_columns, drop_empty_rows
from tablematch.vocabulary import words_of


# ---- renaming the target onto the source --------------------------------------------------------------------------


def equivalent_renames(source: list[str], target: list[str]) -> dict[str, str]:
    """{target name: source name} where the flattened names agree and are unambiguous on both sides."""

    def index(names: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for n in names:
            out.setdefault(flat_name(n), []).append(n)
        return out

    s, t = index(source), index(target)
    return {
        t[k][0]: s[k][0] for k in t if len(t[k]) == 1 and len(s.get(k, ())) == 1 and t[k][0] != s[k][0]
    }


def manual_renames(target: list[str], mapping: dict[str, str]) -> dict[str, str]:
    """{target name: source name} of an explicit {source: target} mapping; skip marks and repeats are left out."""
    out: dict[str, str] = {}
    for s, t in (mapping or {}).items():
        if t and t not in IGNORE_MARKS and t in target and t not in out and t != s:
            out[t] = s
    return out


def similar_renames(
    source: list[str], target: list[str], excluded: set[str] = frozenset(), settings: Settings = DEFAULTS
) -> list[tuple[str, str, float]]:
    """(target name, source name, score) of the remaining columns: best score first, one-to-one."""
    scored = []
    for i, s in enumerate(source):
        if s in target or s in excluded or not flat_name(s):
            continue
        for j, t in enumerate(target):
            if t in source or not flat_name(t):
                continue
            a, b = flat_name(s), flat_name(t)
            score = contained_boost(name_ratio(a, b), a, b, settings.column_containment_score, 3)
            if score >= settings.column_cutoff:
                scored.append((-score, i, j, s, t))
    out, used_s, used_t = [], set(), set()
    for score, _, _, s, t in sorted(scored):
        if s not in used_s and t not in used_t:
            used_s.add(s)
            used_t.add(t)
            out.append((t, s, round(-score, 2)))
    return out


def align(
    source: DataFrame, target: DataFrame, mapping: dict[str, str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Target renamed onto the source: explicit mapping, then equal flattened names, then similar names."""
    names = data_columns(source)
    target = target.withColumnsRenamed(manual_renames(data_columns(target), mapping or {}))
    target = target.withColumnsRenamed(equivalent_renames(names, data_columns(target)))
    skipped = {s for s, t in (mapping or {}).items() if t in IGNORE_MARKS}
    return target.withColumnsRenamed({t: s for t, s, _ in similar_renames(names, data_columns(target), skipped, settings)})


def loose_pairs(source: list[str], target: list[str]) -> list[tuple[str, str]]:
    """Comparable (source, target) columns: same name, else same name without blanks, underscores and hyphens."""
    loose = {loose_name(t): t for t in target}
    return [(s, s if s in target else loose[loose_name(s)]) for s in source if s in target or loose_name(s) in loose]


def schema_difference(spark: SparkSession, source: list[str], target: list[str]) -> DataFrame:
    rows = [("Source-only column", c) for c in source if c not in target]
    rows += [("Target-only column", c) for c in target if c not in source]
    return spark.createDataFrame(rows, "type string, column_name string")


def amount_like(names: list[str], report: bool = False) -> str | None:
    """First column whose name sounds like money; reports use the longer word list."""
    words = REPORT_AMOUNT_WORDS if report else AMOUNT_WORDS
    return next((c for c in names if any(w in c.lower() for w in words)), None)


def mapping_summary(
    spark: SparkSession, source: list[str], target: list[str], keys: list[str], mapping: dict[str, str] | None = None,
    database: bool = False,
) -> DataFrame:
    """One row per source column and per target-only column: how it takes part in the comparison."""
    skipped = "-- Ignored / Skipped --"
    rows = []
    for c in source:
        ignored = (mapping or {}).get(c) in IGNORE_MARKS or c not in target
        rows.append((c, skipped if ignored else c, c in keys, ignored))
    used = {c for c, _, _, ignored in rows if not ignored}
    rows += [("—", c, False, False) for c in target if c not in used and c not in keys]
    table = spark.createDataFrame(rows, "source_column string, target_column string, is_key boolean, ignored boolean")

    def key_type(name: Column) -> Column:
        low = F.lower(name)
        if database:
            return (
                F.when(F.col("is_key"), F.lit("Composite Key" if len(keys) > 1 else "Primary Key"))
                .when(low.endswith("id"), "Foreign Key")
                .when(low.contains("uuid") | low.contains("code") | low.contains("no"), "Unique Key")
                .otherwise("Normal")
            )
        named = low.contains("number") | low.contains("id") | low.contains("code")
        return F.when(F.col("is_key") | named, "Suggested Key").otherwise("Normal")

    target_only = F.col("source_column") == "—"
    return table.select(
        "source_column",
        F.when(target_only, "Normal").otherwise(key_type(F.col("source_column"))).alias("source_key_type"),
        "target_column",
        F.when(F.col("ignored"), "Ignored").otherwise(key_type(F.col("target_column"))).alias("target_key_type"),
        F.when(target_only, "Target Only").when(F.col("is_key"), "Key Match").when(F.col("ignored"), "Skipped")
        .otherwise("Mapped").alias("status"),
    )


def filter_mapping(summary: DataFrame, source: str = "", target: str = "", key_type: str = "All") -> DataFrame:
    """Mapping rows whose names contain the texts and whose key type or status is the wanted one."""
    out = summary
    if source.strip():
        out = out.where(F.lower("source_column").contains(source.lower().strip()))
    if target.strip():
        out = out.where(F.lower("target_column").contains(target.lower().strip()))
    if key_type != "All":
        out = out.where(F.array_contains(F.array("source_key_type", "target_key_type", "status"), key_type))
    return out


# ---- canonical fields ---------------------------------------------------------------------------------------------


@dataclass
class Mapped:
    """Decision for one canonical field."""

    field: str
    column: str | None
    method: str
    status: str
    confidence: float
    candidates: list[str] = field(default_factory=list)


def column_scores(
    df: DataFrame, columns: list[str], settings: Settings = DEFAULTS, kinds: set[str] | None = None
) -> dict[str, dict[str, float]]:
    """Validator scores per column over all its non-blank values, of all validators or of `kinds`; one row per column comes back."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in columns])
    long = df.select(F.inline(cells)).where("v <> ''")
    scores = {k: v for k, v in validator_scores(F.col("v"), settings).items() if kinds is None or k in kinds}
    rows = long.groupBy("column_name").agg(*[v.alias(k) for k, v in scores.items()]).collect()
    return {r["column_name"]: {k: float(r[k]) for k in scores} for r in rows}


def map_columns(
    columns: list[str],
    fields: dict[str, list[str]],
    overrides: dict[str, str] | None = None,
    df: DataFrame | None = None,
    method: str = "exact",
    settings: Settings = DEFAULTS,
) -> list[Mapped]:
    """Resolve canonical fields: override, header word, canonical name, then (exact) the only column whose
    values fit the field's datatype or (fuzzy) the most similar header. A column is claimed once. Values are read at the first
    field that needs them: those of the columns unclaimed by then, for the datatypes of the fields still to come."""
    by_name: dict[str, str] = {}
    for c in columns:
        by_name.setdefault(flat_name(c), c)
    out: list[Mapped] = []
    used: set[str] = set()
    scores: dict[str, dict[str, float]] | None = None
    for i, (name, words) in enumerate(fields.items()):
        pinned = (overrides or {}).get(name)
        word = next((by_name[w] for w in words if w in by_name and by_name[w] not in used), None)
        named = by_name.get(flat_name(name))
        if pinned:
            found = Mapped(name, pinned, "manual_override", "MAPPED", 1.0, [pinned])
        elif word:
            found = Mapped(name, word, "exact_synonym", "MAPPED", 1.0, [word])
        elif named and named not in used:
            found = Mapped(name, named, "exact_normalized_name", "MAPPED", 1.0, [named])
        elif method == "fuzzy":
            found = _most_similar(name, words, [c for c in columns if c not in used], settings)
        else:
            found = Mapped(name, None, "NOT_FOUND", "NOT_FOUND", 0.0)
            kind = FIELD_VALIDATORS.get(name)
            if kind and df is not None:
                if scores is None:
                    kinds = {FIELD_VALIDATORS[f] for f in list(fields)[i:] if f in FIELD_VALIDATORS}
                    scores = column_scores(df, [c for c in columns if c in df.columns and c not in used], settings, kinds)
                fits = [c for c in columns if c not in used and scores.get(c, {}).get(kind, 0.0) >= settings.validator_threshold]
                if len(fits) == 1:
                    found = Mapped(name, fits[0], "datatype_validation", "MAPPED", round(scores[fits[0]][kind], 2), fits)
                elif fits:
                    found = Mapped(name, None, "datatype_validation", "REVIEW_REQUIRED", 0.0, fits)
        if found.column:
            used.add(found.column)
        out.append(found)
    return out


def _most_similar(name: str, words: list[str], columns: list[str], settings: Settings) -> Mapped:
    best, best_score = None, 0.0
    for c in columns:
        flat = flat_name(c)
        for w in words:
            score = name_ratio(flat, w)
            if len(w) >= settings.synonym_containment_length and w in flat:
                score = max(score, settings.synonym_containment_score)
            if score > best_score:
                best, best_score = c, score
    if best is None or best_score < settings.column_cutoff:
        return Mapped(name, None, "NOT_FOUND", "NOT_FOUND", 0.0)
    return Mapped(name, best, "fuzzy_match", "MAPPED", round(best_score, 2), [best])


def as_mapping(decisions: list[Mapped]) -> dict[str, str | None]:
    return {d.field: d.column for d in decisions}


def mapping_report(spark: SparkSession, decisions: list[Mapped]) -> DataFrame:
    rows = [(d.field, d.column, d.method, d.status, float(d.confidence), d.candidates) for d in decisions]
    return spark.createDataFrame(
        rows, "field string, matched_to string, method string, status string, confidence double, candidates array<string>"
    )


def apply_mapping(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Canonical projection: absent fields are null, Amount and the dates are typed, the ordinal is kept."""
    cleaned = {"Amount": clean_amount, "TxnDate": parse_date, "DueDate": parse_date}

    def pick(name: str, actual: str | None) -> Column:
        if actual is None or actual not in df.columns:
            empty = {"Amount": "decimal(18,2)", "TxnDate": "date", "DueDate": "date"}.get(name, "string")
            return F.lit(None).cast(empty)
        return cleaned.get(name, lambda c: c)(F.col(f"`{actual}`"))

    return df.select(*[pick(n, a).alias(n) for n, a in mapping.items()], "_rid")


# ---- raw grids ----------------------------------------------------------------------------------------------------


def header_hits(cells: list, words: set[str]) -> int:
    return sum(1 for c in cells if c is not None and str(c).strip() and flat_name(c) in words)


def detect_header_row(grid: DataFrame, fields: dict[str, list[str]], rows: int = 10) -> int:
    """Ordinal of the leading row with most vocabulary hits; the first wins ties. Reads `rows` rows."""
    words = words_of(fields)
    head = grid.where(F.col("_rid") < rows).collect()
    best, best_hits = 0, -1
    for r in sorted(head, key=lambda r: r["_rid"]):
        hits = header_hits([r[c] for c in data_columns(grid)], words)
        if hits > best_hits:
            best, best_hits = r["_rid"], hits
    return best


def promote_header(grid: DataFrame, row: int) -> DataFrame:
    """Rows below `row`, named by its cells; a blank header becomes Col_i, a repeated one gets a counter."""
    cells = grid.where(F.col("_rid") == row).first()
    names: list[str] = []
    for i, c in enumerate(data_columns(grid)):
        name = str(cells[c]).strip() if cells[c] is not None and str(cells[c]).strip() else f"Col_{i}"
        names.append(name if name not in names else f"{name}.{names.count(name)}")
    body = grid.where(F.col("_rid") > row)
    return body.select(*[F.col(c).alias(n) for c, n in zip(data_columns(grid), names)], "_rid")


#: Ordinals below this are looked at first.
_LEADING = 1000


def drop_repeated_header(df: DataFrame, fields: dict[str, list[str]], hits: int = 2) -> DataFrame:
    """Drop the first data row when it is a second header. It is looked for among the leading ordinals, which a stored grid
    finds without reading the others, and among all rows if none of these is left."""
    first = next(filter(None, (d.orderBy("_rid").limit(1).collect() for d in (df.where(F.col("_rid") < _LEADING), df))), None)
    if first and header_hits([first[0][c] for c in data_columns(df)], words_of(fields)) >= hits:
        return df.where(F.col("_rid") != first[0]["_rid"])
    return df


def load_and_map(
    grid: DataFrame, fields: dict[str, list[str]], overrides: dict[str, str] | None = None, method: str = "exact",
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, list[Mapped]]:
    """Raw grid to canonical table: find and promote the header, drop empty columns and rows and a second header,
    map the columns."""
    table = promote_header(grid, detect_header_row(grid, fields))
    table = drop_repeated_header(drop_empty_rows(drop_empty_columns(table)), fields)
    decisions = map_columns(data_columns(table), fields, overrides, table, method, settings)
    return apply_mapping(table, as_mapping(decisions)), decisions
