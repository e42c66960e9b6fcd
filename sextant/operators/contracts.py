"""Contracts of runs as rules over rows, and of parameters as checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.evaluation import violations


def fits(turns: Column, response: Column, observation: Column, most: Column) -> Column:
    """Whether the right side of a context holds all turns and a last response."""
    return turns * (response + observation) + response <= most


def positions(lines: DataFrame, row: str = "row", begin: str = "start", end: str = "stop", document: str = "line", id_col: str = "id") -> DataFrame:
    """(row, rule) that lines addressed by offsets break: ids are the row numbers,
    offsets rise without gaps, lines are not blank and hold objects.  Rows are
    compared with the one before by a join on the number, not by one sort of all."""
    before = lines.select((F.col(row) + 1).alias(row), F.col(end).alias("__before"))
    both = lines.join(before, row, "left")
    first = F.col(row) == 0
    rules = {
        "id": F.coalesce(F.col(id_col).try_cast("bigint") == F.col(row), F.lit(False)),
        "offset": F.when(first, F.col(begin) == 0).otherwise(F.col(begin) == F.col("__before")),
        "length": F.col(end) > F.col(begin),
        "blank": F.length(F.trim(F.col(document))) > 0,
        "object": (F.length(F.trim(F.col(document))) == 0) | F.json_object_keys(F.col(document)).isNotNull(),
    }
    return violations(both, row, rules)


def catalog(rows: DataFrame, key: str, document: str, canonical: Column, keys: Column) -> DataFrame:
    """(key, rule): catalog lines are canonical, have exactly the ``keys`` and an id
    of their own."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return violations(rows.join(counts, key), key, {"canonical": F.col(document) == canonical, "keys": keys, "unique": F.col("__n") == 1}).distinct()


def stages(rows: DataFrame, file: str, key: str, stage: str, schema: Column) -> DataFrame:
    """(file, rule): a trace file has one stage, one schema and no id twice."""
    summary = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"), F.count_distinct(stage).alias("stages"), F.count_distinct(schema).alias("schemas"))
    return violations(summary, file, {"unique": F.col("n") == F.col("ids"), "stage": F.col("stages") == 1, "schema": F.col("schemas") == 1})


def lineage(runs: DataFrame, key: str = "run", parent: str = "parent", digest: str = "digest", parent_digest: str = "parent_digest", shared: tuple[str, ...] = ()) -> DataFrame:
    """(key, rule): a child's parent is there, its digest is what the child says,
    and both share their provenance.  Runs without a parent break nothing."""
    up = runs.select(F.col(key).alias("__k"), F.col(digest).alias("__d"), *(F.col(c).alias(f"__{c}") for c in shared))
    child = runs.where(F.col(parent).isNotNull()).join(up, F.col(parent) == F.col("__k"), "left")
    there = F.col("__k").isNotNull()
    rules = {"parent": there, "digest": ~there | (F.col(parent_digest) == F.col("__d"))}
    rules |= {c: ~there | F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shared}
    return violations(child, key, rules)


def manifest(declared: DataFrame, rows: DataFrame, part: str, key: str) -> DataFrame:
    """(part, rule): parts of a data set have the rows and the digest that the
    manifest (part, rows, digest) declares, and no part is missing or unknown.
    A digest is that of the ids' hashes, summed, so that no part has to be sorted
    or gathered."""
    found = content_digest(rows, part, key)
    both = declared.alias("d").join(found.alias("f"), part, "full_outer")
    known, there = F.col("d.rows").isNotNull(), F.col("f.rows").isNotNull()
    return violations(both, part, {"missing": there, "unknown": known, "rows": ~(known & there) | (F.col("d.rows") == F.col("f.rows")), "digest": ~(known & there) | (F.col("d.digest") == F.col("f.digest"))})


def content_digest(rows: DataFrame, part: str, key: str) -> DataFrame:
    """part, rows, digest of the ids of each part, whatever their order."""
    number = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("digest"))


def config(runs: DataFrame, key: str, document: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, rule) of run configurations (JSON) by dotted path: ``(path, comparison,
    value)``, values compared as JSON text, so that 1 is not true; a missing path
    breaks its rule."""
    checks = {}
    for path, op, want in rules:
        got = F.get_json_object(F.col(document), f"$.{path}")
        number, limit = got.try_cast("double"), F.lit(want).try_cast("double")
        checks[f"{path} {op} {want}"] = {"==": got == want, "!=": got != want, ">=": number >= limit, "<=": number <= limit, ">": number > limit, "<": number < limit}[op]
    return violations(runs, key, checks)


def threshold(name: str, value: float, ratio: bool = False) -> float:
    """A finite threshold, between 0 and 1 if it is a ratio."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number, not {value!r}")
    if ratio and not 0 <= value <= 1:
        raise ValueError(f"{name} must be a ratio, not {value!r}")
    return float(value)


def expected_rows(prompts: int, group: int, batch: int, drop_last: bool = True) -> int:
    """Rows that an evaluation writes, and so what its trace must hold."""
    if min(group, batch) < 1:
        raise ValueError("group and batch must be positive")
    used = prompts // batch * batch if drop_last else prompts
    return used * group


def by_index(rows: DataFrame, index: DataFrame, source_index: str = "source_index") -> DataFrame:
    """The rows a split lists, in the order of the list (``place``)."""
    return index.select("place", source_index).join(rows, source_index)


def with_priority(*sources: DataFrame, key: str) -> DataFrame:
    """Rows of all sources; of a key that several have, that of the last one."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("__i", F.lit(i))
        out = part if out is None else out.unionByName(part)
    columns = [c for c in out.columns if c != "__i"]
    return out.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*columns), "__i").alias("r")).select("r.*")


def budgeted(pieces: Column, budget: Column) -> Column:
    """The longest prefix of the pieces (of any tokenizer) within a budget, joined."""
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.least(budget, F.size(pieces)), F.lit(0))), "")


def first_action(pieces: Column, closers: tuple[str, ...]) -> Column:
    """How many pieces it takes until the text holds a closer; null if it never does.
    Piece lengths are summed to the closer's end, which no prefix has to be decoded
    for."""
    text = F.array_join(pieces, "")
    ends = [F.when(F.instr(text, c) > 0, F.instr(text, c) + len(c) - 1) for c in closers]
    end = F.least(*ends) if len(ends) > 1 else ends[0]
    # The end travels with the sums: what a lambda refers to is worked out again for each piece.
    step = lambda acc, p: F.struct((acc["n"] + F.when(acc["at"] < acc["end"], 1).otherwise(0)).alias("n"), (acc["at"] + F.length(p)).alias("at"), acc["end"].alias("end"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), end.alias("end")), step, lambda acc: F.when(acc["end"].isNotNull(), acc["n"]))


def stop_at(text: Column, stops: tuple[str, ...]) -> Column:
    """Up to and with the first stop sequence."""
    pattern = "(?s)^(.*?(?:" + "|".join(f"\\Q{s}\\E" for s in stops) + "))"
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(text)


def trace_identity(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Identity columns filled from defaults where they are null or not there."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key's largest ``order``, all of them if tied.  The largest is
    aggregated before it moves, so a hot key's rows are not sorted in one task."""
    best = df.groupBy(F.col(key).alias("__k")).agg(F.max(order).alias("__m"))
    return df.join(best, F.col(key).eqNullSafe(F.col("__k")) & (F.col(order) == F.col("__m")), "left_semi")
