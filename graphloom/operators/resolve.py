"""Names that a parser couldn't bind: a census of them, binding by the nearest scope that has one candidate, and what stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identifiers as ids
from graphloom.sources.storage import reclaim, save

MARK = "unresolved::"
# Classes of targets by how what follows the mark begins.
CLASSES = {"import::": "import", "pyrel::": "relative_import", "grpc::": "grpc", "razor_using::": "razor_using", "*.": "wildcard_member"}

#: Scopes, the nearest first, with the tier and confidence of what they bind (the choice is ours).
SCOPES = {"file": ("ast_inferred", 0.7), "folder": ("ast_inferred", 0.7), "import": ("ast_resolved", 1.0), "repo": ("text_matched", 0.4)}

KEY = ["src", "dst", "kind", "line"]


def tail(target: Column) -> Column:
    """What follows the first mark in an unresolved target."""
    return F.substring(target, F.locate(MARK, target) + len(MARK), F.length(target))


def target_class(target: Column) -> Column:
    rest = tail(target)
    out = F.when(rest.contains("::"), "qualified_symbol").otherwise("bare_symbol")
    for start, name in CLASSES.items():  # no two of them begin alike
        out = F.when(rest.startswith(start), name).otherwise(out)
    return F.when(rest == "", "empty").otherwise(out)


def census(edges: DataFrame) -> DataFrame:
    """(kind, target_class, bucket_count, pending_total, group_count) of unresolved edges: a row for each kind of edge and class of target."""
    open_ = edges.where(ids.is_unresolved(F.col("dst"))).groupBy("kind", target_class(F.col("dst")).alias("target_class")).agg(F.count("*").alias("bucket_count"))
    whole = open_.agg(F.sum("bucket_count").alias("pending_total"), F.count("*").alias("group_count"))  # one row
    return open_.join(F.broadcast(whole))


def _symbols(nodes: DataFrame) -> DataFrame:
    """(repo, language, owner, name, file, folder, id): a symbol is asked for by its name, as a member of anything, and as one of its owner."""
    asked = F.array_compact(F.array(F.lit(""), F.when(F.col("owner") != "", "*"), F.when(F.col("owner") != "", F.col("owner"))))
    named = nodes.where("id is not null and name <> '' and kind <> 'file'")
    rows = named.select(F.coalesce("repo_prefix", F.lit("")).alias("repo"), F.coalesce("language", F.lit("")).alias("language"), asked.alias("owners"), "name", F.col("file_path").alias("file"), "id")
    return rows.select("repo", "language", F.explode("owners").alias("owner"), "name", "file", ids.directory_of(F.col("file")).alias("folder"), "id")


def _sites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The unresolved edges, once each, with what they ask for and from where; for imports name is a path."""
    rest, kind = tail(F.col("dst")), target_class(F.col("dst"))
    asks = edges.where(ids.is_unresolved(F.col("dst"))).select(*KEY).distinct().withColumn("class", kind)
    path = F.when(F.col("class") == "import", F.substring(rest, len("import::") + 1, F.length(rest)))
    name = F.when(F.col("class") == "bare_symbol", rest).when(F.col("class") == "wildcard_member", F.substring(rest, 3, F.length(rest))).when(F.col("class") == "qualified_symbol", F.substring_index(rest, "::", -1))
    owner = F.when(F.col("class") == "wildcard_member", "*").when(F.col("class") == "qualified_symbol", F.element_at(F.split(rest, "::"), -2)).otherwise("")
    asks = asks.select(*KEY, "class", F.coalesce(path, name).alias("name"), owner.alias("owner")).where("name <> ''")
    at = nodes.where("id is not null").groupBy(F.col("id").alias("src")).agg(F.min(F.struct(F.coalesce("repo_prefix", F.lit("")).alias("repo"), F.coalesce("language", F.lit("")).alias("language"), F.col("file_path").alias("file"))).alias("x"))
    return asks.join(at.select("src", "x.*"), "src").withColumn("folder", ids.directory_of(F.col("file")))


def bind(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (src, dst, kind, line, origin, confidence) with a column `scope`, dst bound where a name has one meaning.

    nodes are (id, kind, name, file_path, language, repo_prefix, owner): owner names the type that a member is of. `unresolved::a` asks for a symbol
    a, `unresolved::T::a` for one that T owns, `unresolved::*.a` for one that any type owns, `unresolved::import::p` for the file p. Candidates are of the site's
    repository and language. The nearest scope that has any decides: the site's file, its folder, files that its file imports, the repository.
    One candidate there is bound, several leave the site as it is, since a guess is worse than none. Imports of paths are bound first, then imports of names,
    which open further files to each other, in rounds until one binds nothing, then all else; so a second call changes nothing. Sites of nodes that aren't there, and other classes, stay.
    Nodes given twice count once. Null names, files and targets match nothing; columns beside these are let go.

    Candidates are counted by key before sites meet them, so a site is joined with one row a scope, however frequent its name.
    """
    name = ["repo", "language", "owner", "name"]
    nodes = save(spark, nodes.select("id", "kind", "name", "file_path", "language", "repo_prefix", "owner"), "resolve-nodes")
    edges = save(spark, edges.select(*KEY, "origin", "confidence"), "resolve-edges")  # read by every step, made once
    one = [F.count_distinct("id").alias("n"), F.min("id").alias("id")]
    symbols = save(spark, _symbols(nodes), "resolve-symbols")
    paths = nodes.where("kind = 'file' and id is not null").groupBy(F.coalesce("repo_prefix", F.lit("")).alias("repo"), F.col("file_path").alias("name")).agg(*one)
    files = save(spark, nodes.where("id is not null").groupBy("id").agg(F.min("file_path").alias("file")).where("file is not null"), "resolve-files")
    open_ = save(spark, _sites(nodes, edges), "resolve-sites")
    given = edges.where((F.col("kind") == "imports") & ~ids.is_unresolved(F.col("dst"))).select("src", "dst")
    bound = []

    def met(sites, scope, by, found):
        hit = found.select(*by, F.struct("n", "id").alias(scope))
        return sites.join(hit, by, "left")

    def step(sites: DataFrame) -> DataFrame:
        known = given
        for b in bound:
            known = known.unionByName(b.where("kind = 'imports'").select("src", F.col("id").alias("dst")))
        links = known.join(files.select(F.col("id").alias("src"), "file"), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("far")), "dst").select("file", "far").distinct()
        names = sites.where("class <> 'import'")
        asked = names.select(*name, "file").distinct().join(links, "file")
        near = symbols.groupBy(*name, F.col("file").alias("far")).agg(F.count_distinct("id").alias("m"), F.min("id").alias("id"))
        far = asked.join(near, [*name, "far"]).groupBy(*name, "file").agg(F.sum("m").alias("n"), F.min("id").alias("id"))
        rows = met(names, "file_", [*name, "file"], symbols.groupBy(*name, "file").agg(*one))
        rows = met(rows, "folder_", [*name, "folder"], symbols.groupBy(*name, "folder").agg(*one))
        rows = met(rows, "import_", [*name, "file"], far)
        rows = met(rows, "repo_", name, symbols.groupBy(*name).agg(*one))
        pick = F.coalesce(*[F.when(F.col(f"{s}_").isNotNull(), F.struct(F.lit(s).alias("scope"), F.col(f"{s}_.n").alias("n"), F.col(f"{s}_.id").alias("id"))) for s in SCOPES])
        paths_ = sites.where("class = 'import'").join(paths, ["repo", "name"]).select(*KEY, F.struct(F.lit("import").alias("scope"), "n", "id").alias("x"))
        rows = rows.select(*KEY, pick.alias("x")).unionByName(paths_)
        return save(spark, rows.where("x.n = 1").select(*KEY, "x.scope", "x.id"), "resolve-bound")

    for round_ in ("class = 'import'", "kind = 'imports' and class <> 'import'", "kind <> 'imports' and class <> 'import'"):
        part = save(spark, open_.where(round_), "resolve-round")
        while part.limit(1).count():
            new = step(part)
            if not new.limit(1).count():
                reclaim(spark, new)
                break
            bound.append(new)
            if "kind = 'imports'" not in round_:  # one look decides; only imports by name open files to each other
                break
            rest = save(spark, part.join(new, KEY, "left_anti"), "resolve-round")
            reclaim(spark, part)
            part = rest
        reclaim(spark, part)
    reclaim(spark, open_)
    reclaim(spark, symbols, files, nodes)
    if not bound:
        return edges.withColumn("scope", F.lit(None).cast("string"))
    done = bound[0]
    for b in bound[1:]:
        done = done.unionByName(b)
    by = lambda k: F.coalesce(*[F.when(F.col("scope") == s, F.lit(v[k])) for s, v in SCOPES.items()])
    out = edges.join(done, KEY, "left")
    return out.select("src", F.coalesce("id", "dst").alias("dst"), "kind", "line", F.coalesce(by(0), "origin").alias("origin"), F.coalesce(by(1), "confidence").alias("confidence"), "scope")


def name_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, verified, candidates) of symbols: edges that reach them, and open sites that name them, so that no callers isn't read as none."""
    # stored, or the condition on the class would be put before the sites are told apart, with the class spelled out in it many times
    sites = save(edges.sparkSession, _sites(nodes, edges), "resolve-sites").where("class <> 'import'").groupBy("repo", "language", "owner", "name").agg(F.count("*").alias("sites"))
    open_ = _symbols(nodes).select("id", "repo", "language", "owner", "name").distinct().join(sites, ["repo", "language", "owner", "name"]).groupBy("id").agg(F.sum("sites").alias("candidates"))
    sure = edges.where(~ids.is_unresolved(F.col("dst"))).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("verified"))
    return open_.join(sure, "id", "left").select("id", F.coalesce("verified", F.lit(0)).alias("verified"), "candidates")
