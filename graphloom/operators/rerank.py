"""Second stage of search over a bounded batch of candidates: signals, weights, file diversity and packing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the signals.
WEIGHTS = {
    "bm25": 1.0,
    "semantic": 0.8,
    "fan_in": 0.6,
    "fan_out": 0.2,
    "churn": 0.3,
    "community": 0.3,
    "api_signature": 0.45,
    "recency": 0.3,
    "file_coherence": 0.3,
    "path_penalty": 0.4,
    "definition_bias": 0.6,
    "provenance": 0.15,
}

# Constant of reciprocal ranks, half-life in days, rows of a file left in place, places lost by each further one.
K, HALF_LIFE, ALLOWED, STEP = 60, 30.0, 2, 3

# Multipliers of paths; the smallest that fits counts.
PENALTIES = {"test": 0.3, "compat": 0.5, "examples": 0.5, "declarations": 0.7, "barrels": 0.7, "entries": 0.9}

#: What each multiplier is for: folders, then file names (the patterns are ours).
PATHS = {
    "test": r"(^|/)(tests?|__tests__|specs?|e2e|fixtures?|testdata)(/|$)|(^|/)test_[^/]+$|[._](test|spec)s?\.[a-z]+$|[a-z]Tests?\.[a-z]+$",
    "compat": r"(^|/)(compat|legacy|polyfills?|shims?|backports?|deprecated)/",
    "examples": r"(^|/)(examples?|demos?|samples?|sandbox|playground)/",
    "declarations": r"\.d\.[cm]?ts$|\.(pyi|hpp|hxx|hh)$|(^|/)include/.*\.h$",
    "barrels": r"(^|/)(index\.[cm]?jsx?|__init__\.py)$",
    "entries": r"(^|/)(index\.tsx?|mod\.rs|lib\.rs)$",
}

FIELDS = ("kind", "flavor", "lang", "path", "repo", "project", "name")


def query_class(query: str) -> str:
    """What a query looks like: a signature, a path, a symbol or a concept."""
    q = query.strip()
    if re.search(r"[()]|=>|->", q):
        return "signature"
    if not q or re.search(r"\s", q):
        return "concept"
    return "path" if "/" in q else "symbol"


def field_query(query: str) -> tuple[dict[str, str], str]:
    """(fields, rest): `kind:`, `lang:` and the like lifted out of a query; an empty value stays in the text."""
    fields, rest = {}, []
    for word in query.split():
        name, sep, value = word.partition(":")
        if sep and value and name.lower() in FIELDS:
            fields[name.lower()] = value
        else:
            rest.append(word)
    return fields, " ".join(rest)


def _fold(text: Column) -> Column:
    """Lower case, unless that changes the length in bytes."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.octet_length(text), low).otherwise(text)


def substring_rank(name: Column, id_: Column, query: str) -> Column:
    """0 for the whole name, 1 for its start, 2 inside it, 3 inside the id, null for nothing."""
    q, n = query.lower(), _fold(name)
    return F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2).when(_fold(id_).contains(q), 3)


def substring_search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, name, rank) of the best by substring; shorter names (in bytes) first among equals."""
    found = nodes.where(~F.col("kind").isin("file", "import")).select("id", "name", "file_path", substring_rank(F.col("name"), F.col("id"), query).alias("rank"))
    return found.where("rank is not null").orderBy("rank", F.octet_length("name"), "id").limit(limit).select("id", "name", "rank")


def path_penalty(path: Column) -> Column:
    out = F.lit(1.0)
    for kind, value in sorted(PENALTIES.items(), key=lambda kv: -kv[1]):
        out = F.when(path.rlike(f"(?i){PATHS[kind]}" if kind != "test" else PATHS[kind]), value).otherwise(out)
    return F.when(path == "", 1.0).otherwise(F.coalesce(out, F.lit(1.0)))


def definition_bias(name: Column, path: Column, query: str) -> Column:
    """1 for the name itself, 0.6 for the file's, 0.4 for four common first letters; nothing unless the query is a symbol."""
    q = query.strip().lower()
    if query_class(query) != "symbol":
        return F.lit(0.0)
    stem = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    start = F.lit(False) if len(q) < 4 else F.lower(name).startswith(q[:4])
    return F.when(F.lower(name) == q, 1.0).when(stem == q, 0.6).when(start, 0.4).otherwise(0.0)


def _reciprocal(rank: Column) -> Column:
    """1 for the best of a channel, falling with its rank from 0; nothing for a row that the channel lacks."""
    return F.when(rank >= 0, (K + 1.0) / (K + rank + 1.0)).otherwise(0.0)


def _log_norm(value: Column, by: Window) -> Column:
    most = F.max(value).over(by)
    return F.when(most > 0, F.log1p(value) / F.log1p(most)).otherwise(0.0)


def rerank(batch: DataFrame, query: str, group: str | None = None) -> DataFrame:
    """batch with one column for each signal, `score` and `place` (from 0) after file diversity.

    A batch has id, kind, name, file_path, text_rank and vector_rank (null: absent), fan_in, fan_out, churn, days
    since the last change (null: unknown), provenance (mean weight of uses, null: none), cluster and signature. Batches
    are cut to the best of each channel before, so a window over one is small; `group` holds several batches apart.
    """
    keys = [group] if group else []
    by = Window.partitionBy(*keys)
    in_file, in_cluster = Window.partitionBy(*keys, "file_path"), Window.partitionBy(*keys, "cluster")
    words = [w for w in re.split("[^a-z0-9]+", query.lower()) if len(w) >= 2]
    has = sum((F.lower("signature").contains(w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    file_sum = F.when((F.col("file_path") != "") & (F.count("*").over(in_file) >= 2), F.sum(F.when(F.col("text_rank") >= 0, 1.0 / (F.col("text_rank") + 1.0)).otherwise(0.0)).over(in_file)).otherwise(0.0)
    rows = batch.withColumn("file_sum", file_sum).withColumn("here", F.when(F.col("cluster").isNotNull(), F.count("*").over(in_cluster)).otherwise(0))
    signals = {
        "bm25": _reciprocal(F.col("text_rank")),
        "semantic": _reciprocal(F.col("vector_rank")),
        "fan_in": _log_norm(F.col("fan_in"), by),
        "fan_out": _log_norm(F.col("fan_out"), by),
        "churn": _log_norm(F.col("churn"), by),
        "community": F.coalesce(F.col("here") / F.nullif(F.max("here").over(by), F.lit(0)), F.lit(0.0)),
        "api_signature": F.when(F.col("kind").isin("function", "method"), F.coalesce(has, F.lit(0.0))).otherwise(0.0),
        "recency": F.coalesce(F.pow(F.lit(0.5), F.greatest(F.col("days"), F.lit(0.0)) / HALF_LIFE), F.lit(0.0)),
        "file_coherence": F.coalesce(F.col("file_sum") / F.nullif(F.max("file_sum").over(by), F.lit(0.0)), F.lit(0.0)),
        "path_penalty": path_penalty(F.col("file_path")),
        "definition_bias": definition_bias(F.col("name"), F.col("file_path"), query),
        "provenance": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("provenance") - 0.25) / 0.75)), F.lit(0.0)),
    }
    rated = rows.select(*keys, "id", "file_path", *[x.alias(s) for s, x in signals.items()])
    scored = rated.withColumn("score", F.round(sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0.0)), 6))
    return diversify(scored, [F.col("score").desc(), F.col("id")], keys)


def diversify(rows: DataFrame, order: list, keys: list[str] | None = None) -> DataFrame:
    """rows with `place`: from the third row of a file on, each falls STEP places for every row of its file beyond ALLOWED."""
    keys = keys or []
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    above = F.row_number().over(Window.partitionBy(*keys, "file_path").orderBy(*order)) - 1
    late = F.when((F.col("file_path") != "") & (above >= ALLOWED), STEP * (above - ALLOWED + 1)).otherwise(0)
    held = rows.withColumn("rank", rank).withColumn("held", F.col("rank") + late)
    return held.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("held", "rank")) - 1).drop("held")


def pack(rows: DataFrame, key: str, strategy: str, budget: int) -> DataFrame:
    """(key, id, place): what fits a budget of tokens, going on after a row too large for the rest.

    rows has key, id, file_path, rank, score and tokens, a bounded batch for each key. `top-k` keeps
    the ranks, `density` goes by score for a token, `file-grouped` by files of the most score. The greedy
    choice is a fold over the batch's ordered array.
    """
    free = F.col("tokens") <= 0
    if strategy == "density":
        first = [(-F.when(free, F.lit(float("inf"))).otherwise(F.col("score") / F.col("tokens"))).alias("o1")]
    elif strategy == "file-grouped":
        first = [(-F.round(F.sum("score").over(Window.partitionBy(key, "file_path")), 9)).alias("o1"), F.col("file_path").alias("o2")]
    else:
        first = []
    ordered = rows.select(key, F.struct(*first, "rank", "id", F.greatest("tokens", F.lit(0)).cast("long").alias("cost")).alias("x")).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    element = next(f.dataType.elementType["id"].dataType for f in ordered.schema if f.name == "xs").simpleString()
    fold = f"aggregate(xs, named_struct('used', 0L, 'ids', cast(array() as array<{element}>)), (s, x) -> if({budget}L <= 0 or x.cost = 0 or s.used + x.cost <= {budget}L, named_struct('used', s.used + x.cost, 'ids', array_append(s.ids, x.id)), s), s -> s.ids)"
    return ordered.select(key, F.posexplode(F.expr(fold)).alias("place", "id")).select(key, "id", "place")
