"""Mixing sources to target weights by entropy balancing.

Of all document rates that meet each source's token target, entropy balancing takes
those nearest to one copy each in relative entropy: r = exp(lam * size / mean size),
held to `cap` copies. The multipliers lam solve a convex dual. Its gradient and Hessian
are sums over (source, size, number of documents), a table that is aggregated once and
then summed again by every distributed Newton iteration; lam itself is a table with a
row a source, so nothing depends on how many sources there are. Newton steps that leave
the bracket of the root are halved back into it. Sums are of integers, so reruns agree.

Rates are then rounded into copies: documents are dealt by hash to blocks of about
BLOCK within their source (equal rows to different ones), and in each block, largest first, every document takes the
number of copies nearest to its rate plus the tokens still owed by the larger ones.
What a block misses in the end is of the order of its smallest document.

DataFrame operations only. Defined cases: a null text has size 0 and is never taken;
null sources form one source, last in order; targets reach cap times the source's size
at most; rows repeated in id and text are separate documents (`mix` gives them the same
number of copies, the least of theirs); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, field, table, unpack, whole_row
from graphloom.sources.storage import save

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK = 512
#: Rates are summed in these units.
UNIT = 1 << 30


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text in the order of the sources, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def indexed(spark: SparkSession, df: DataFrame, order: str) -> DataFrame:
    """df with its position in the order, counted by range partitions rather than in one task."""
    parts = save(spark, df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "indexed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return parts.join(F.broadcast(starts), F.col("part") == F.col("of")).withColumn("index", F.col("start") + F.col("nth")).drop("part", "nth", "of", "n", "start")


def targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(skey, source_size, docs, target) of each source."""
    sources = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    wheel = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    state = save(spark, indexed(spark, sources, "skey").withColumn("weight", wheel).drop("index"), "sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    level, held, most = 0.0, -1, F.col("source_size") * float(cap)
    while True:  # each pass reshares what those at their cap leave over; each but the last caps another source
        full = F.col("weight") * level >= most
        n, taken, free = state.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == held or not free:
            break
        held, level = n, (share * total - cap * int(taken)) / free
    return state.withColumn("target", F.least(most, F.col("weight") * level) if held >= 0 and total else F.lit(0.0))


def balance(spark: SparkSession, sizes: DataFrame, sources: DataFrame, cap: float = CAP, tolerance: float = 1e-7) -> DataFrame:
    """sources with lam (null: every document at its cap) after distributed Newton iterations."""
    hist = save(spark, sizes.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n")), "sizes-by-source")
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    exact = lambda r, c: F.sum((F.round(r * UNIT).cast("decimal(20,0)") * c.cast("decimal(18,0)"))) / F.lit(float(UNIT))
    got = exact(rate, F.col("n") * F.col("size")).cast("double")
    slope = exact(F.when(rate < cap, rate * x).otherwise(0.0), F.col("n") * F.col("size")).cast("double")
    start = sources.withColumn("mean", F.greatest(F.col("source_size") / F.greatest(F.col("docs"), F.lit(1)), F.lit(1.0)))
    start = start.withColumn("fixed", (F.col("target") >= F.col("source_size") * float(cap)) | (F.col("source_size") == 0))
    state = save(spark, start.select("*", F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")), "dual")
    names = state.columns
    for _ in range(100):  # the bracket at least halves, so this ends long before
        sums = hist.join(state.where("not fixed").select(F.col("skey").alias("k"), "mean", "lam"), F.col("skey") == F.col("k")).groupBy("k").agg(got.alias("got"), slope.alias("slope"))
        gap = F.col("got") - F.col("target")
        now = state.join(sums, F.col("skey") == F.col("k"), "left").withColumn("off", F.when(F.col("fixed"), 0.0).otherwise(F.coalesce(gap, F.lit(0.0)) / F.greatest(F.col("target"), F.lit(1e-9))))
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        now = now.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("newton", F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0)))
        inside = (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        half = F.when(F.col("hi2") == float("inf"), F.col("lam") * 2 + 1).when(F.col("lo2") == float("-inf"), F.col("lam") * 2 - 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        step = F.when(F.abs("off") <= tolerance, F.col("lam")).otherwise(F.when(inside, F.col("newton")).otherwise(half))
        state = save(spark, now.withColumn("next", step).select(*[F.col({"lam": "next", "lo": "lo2", "hi": "hi2"}.get(c, c)).alias(c) for c in names], "off"), "dual")
        if (state.agg(F.max(F.abs("off"))).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError("the rates of the sources don't settle")
    return state.withColumn("lam", F.when(~F.col("fixed"), F.col("lam"))).select("skey", "source_size", "target", "mean", "lam")


def rounded(sizes: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes(id, h, skey, size) with source_size, target, rate and copies."""
    state = solved.select(F.col("skey").alias("k"), "source_size", "target", "mean", "lam", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    same = sizes.where("size > 0").groupBy("id", "h", "skey", "size").agg(F.count("*").alias("times"))  # equal rows are dealt to different blocks
    rows = same.join(state, F.col("skey") == F.col("k")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    rate = F.when(F.col("lam").isNull(), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rows = rows.withColumn("rate", rate).withColumn("block", F.pmod(F.xxhash64("h", "nth"), F.greatest("blocks", F.lit(1))))
    none = sizes.where("size = 0").join(state, F.col("skey") == F.col("k")).select("id", "h", "skey", "size", "source_size", "target", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    item = F.struct((-F.col("size")).alias("neg"), "h", "id", "rate")
    blocks = rows.groupBy("skey", "block").agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    copies = F.expr(f"""
        aggregate(items, named_struct('owed', 0D, 'out', cast(array() AS array<int>)), (acc, x) -> named_struct(
          'owed', acc.owed - x.neg * x.rate + x.neg * if(x.neg = 0, 0, least({cap}, greatest(0, cast(floor((acc.owed - x.neg * x.rate) / -x.neg + 0.5) AS int)))),
          'out', concat(acc.out, array(if(x.neg = 0, 0, least({cap}, greatest(0, cast(floor((acc.owed - x.neg * x.rate) / -x.neg + 0.5) AS int)))))))).out""")
    flat = blocks.select("skey", "source_size", "target", F.explode(F.arrays_zip("items", copies.alias("copies"))).alias("z"))
    return flat.select(F.col("z.items.id").alias("id"), F.col("z.items.h").alias("h"), "skey", (-F.col("z.items.neg")).alias("size"), "source_size", "target", F.col("z.items.rate").alias("rate"), F.col("z.copies").alias("copies")).unionByName(none)


def copies_of(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(id, h, skey, size, source_size, target, rate, copies): one row for each row of docs."""
    text = docs[f"`{text_col}`"]
    sizes = save(spark, docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{id_col}`"], text).alias("h"), source_key(docs[f"`{source_col}`"]).alias("skey"), words(text).alias("size")), "sizes")
    aims = targets(spark, sizes, weights, share, cap)
    solved = save(spark, balance(spark, sizes, aims, cap).join(sizes.groupBy("skey").agg(F.count("*").alias("rows")), "skey"), "rates")
    return rounded(sizes, solved, cap)


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with every row repeated as often as the mix takes it."""
    taken = copies_of(spark, docs, id_col, text_col, **kw).groupBy("id", "h").agg(F.min("copies").alias("copies")).where("copies > 0")
    rows = whole_row(docs).withColumn("rid", field(id_col)).withColumn("rh", F.xxhash64(field(id_col), field(text_col)))
    out = rows.join(taken, rows["rid"].eqNullSafe(taken["id"]) & (rows["rh"] == taken["h"])).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpack(out, docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies_of(spark, table(spark, sf_dir, "documents"))
    source = F.when(F.col("skey").startswith("0"), F.substring("skey", 2, 1 << 30))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate", source.alias("source"))
