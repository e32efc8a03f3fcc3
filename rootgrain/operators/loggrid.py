"""Published grids of log counts against the logs that they sum up.

A published table of a case has a row for each bucket of seconds, and a column for each cluster of a
container. Where log rows name their cluster, by number or by template, every cell is checked; where
they do not, a container's cells of a bucket may at most sum up to its log rows.

logs: case_id, container, cluster_id, template, at_seconds. clusters: case_id, key, container, template.
published: case_id, line, cells (the texts of a row; the first line of a case is its header).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a bucket of published grids (a fixed value of the format).
SECONDS = 15
EXAMPLES = 5


def bucket(seconds: Column) -> Column:
    return F.floor(seconds / SECONDS).cast("long") * SECONDS


def columns(clusters: DataFrame) -> DataFrame:
    """(case_id, names): container_key of all clusters of a case, in order of keys as numbers, each once."""
    name = F.concat_ws("_", "container", "key")
    named = clusters.where("container IS NOT NULL AND key IS NOT NULL").select("case_id", F.struct(F.col("key").try_cast("double").alias("number"), F.col("key").alias("key"), F.col("container").alias("container"), name.alias("name")).alias("c"))
    return named.groupBy("case_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("c")), lambda c: c["name"])).alias("names"))


def assigned(logs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(case_id, bucket, into, tier, masked, contradicted, n): log rows summed by where they are counted.

    into are the columns: that of (container, cluster_id) where there is such a cluster (tier id), else
    all with the row's container and whole template (tier template), else none (dropped). masked says
    that a row counted by its number has a template without a cluster, contradicted that its template
    names other clusters. Rows are summed by all that decides before anything is joined, so that a
    container or template of most rows is a few of them.
    """
    name = F.concat_ws("_", "container", "key").alias("name")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    alike = logs.groupBy("case_id", "container", text("cluster_id").alias("cluster_id"), text("template").alias("template"), bucket(F.col("at_seconds")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by_id = clusters.where("key <> ''").select("case_id", "container", F.col("key").alias("cluster_id"), name.alias("own")).distinct()
    by_template = clusters.groupBy("case_id", "container", "template").agg(F.array_sort(F.collect_set(name)).alias("told"))
    found = alike.join(by_id, ["case_id", "container", "cluster_id"], "left").join(by_template, ["case_id", "container", "template"], "left")
    own, told = F.col("own"), F.col("told")
    return found.select(
        "case_id", "bucket", F.when(own.isNotNull(), F.array(own)).otherwise(told).alias("into"), F.when(own.isNotNull(), "id").when(told.isNotNull(), "template").otherwise("dropped").alias("tier"),
        (own.isNotNull() & told.isNull()).alias("masked"), F.coalesce(own.isNotNull() & ~F.array_contains(told, own), F.lit(False)).alias("contradicted"), "n",
    )


def totals(assigned: DataFrame) -> DataFrame:
    """(case_id, seen, by_id, by_template, dropped, masked, contradicted, lowest, highest)."""
    n = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    tier = F.col("tier")
    return assigned.groupBy("case_id").agg(
        F.sum("n").alias("seen"), n(tier == "id").alias("by_id"), n(tier == "template").alias("by_template"), n(tier == "dropped").alias("dropped"), n(F.col("masked")).alias("masked"),
        n(F.col("contradicted")).alias("contradicted"), F.min("bucket").alias("lowest"), F.max("bucket").alias("highest"),
    )


def counts(assigned: DataFrame) -> DataFrame:
    """(case_id, bucket, counts): a map from columns to their rows, for buckets with any."""
    cells = assigned.select("case_id", "bucket", F.explode("into").alias("name"), "n").groupBy("case_id", "bucket", "name").agg(F.sum("n").alias("n"))
    return cells.groupBy("case_id", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts"))


def dense(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(case_id, bucket, cells): the rows of the grid, one for each bucket from the first log row to the last."""
    spans = totals(assigned).select("case_id", F.explode(F.sequence("lowest", "highest", F.lit(SECONDS))).alias("bucket")).join(columns(clusters), "case_id")
    told = spans.join(counts(assigned), ["case_id", "bucket"], "left")
    return told.select("case_id", "bucket", F.transform("names", lambda c: F.coalesce(F.try_element_at("counts", c), F.lit(0).cast("long"))).alias("cells"))


def _lines(published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, header) and (case_id, row, cells), rows from 0. A table was one text, so that its lines fit a task."""
    numbered = published.withColumn("row", F.row_number().over(Window.partitionBy("case_id").orderBy("line")) - 2)
    return numbered.where("row = -1").select("case_id", F.col("cells").alias("header")), numbered.where("row >= 0").select("case_id", "row", "cells")


def compare(published: DataFrame, logs: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each case with a published table: (case_id, outcome, header_matches, rows,
    expected_rows, columns, cells, wrong, examples) and the totals() of its logs.

    The header has to be `time` and columns(); with another one no row is compared and rows, columns,
    cells and wrong are 0. The n-th row stands for the n-th bucket from the first log row on, its time
    included; wrong counts cells that differ as texts, missing and further ones too. examples are the
    first 5 of them in reading order, (row, name, published, reduced). outcome is reproduced, or
    disagreed where the header, a cell, the number of rows or a contradicted log row says so. Cases
    whose table has no line are left out, cases without log rows or clusters expect no row or column.
    """
    header, body = _lines(published)
    held = assigned(logs, clusters)
    facts = header.join(columns(clusters), "case_id", "left").join(totals(held), "case_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    facts = facts.withColumn("header_matches", F.array_join("header", ",") == F.array_join(F.concat(F.array(F.lit("time")), "names"), ","))
    facts = facts.withColumn("expected_rows", F.coalesce((F.col("highest") - F.col("lowest")) / SECONDS + 1, F.lit(0)).cast("long"))

    rows = body.join(facts.where("header_matches").select("case_id", "names", "lowest"), "case_id").withColumn("bucket", F.col("lowest") + F.col("row") * SECONDS)
    rows = rows.join(counts(held), ["case_id", "bucket"], "left")
    reduced = F.concat(F.array(F.coalesce(F.col("bucket").cast("string"), F.lit(""))), F.transform("names", lambda c: F.coalesce(F.try_element_at("counts", c), F.lit(0).cast("long")).cast("string")))
    rows = rows.withColumn("reduced", reduced).withColumn("width", F.greatest(F.size("cells"), F.size("reduced")))
    cell = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    pairs = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.struct(F.col("row"), i.alias("at"), F.when(i == 0, "time").otherwise(F.coalesce(F.get("names", i - 1), F.lit("?"))).alias("name"), cell("cells", i).alias("published"), cell("reduced", i).alias("reduced")))
    rows = rows.withColumn("differ", F.filter(pairs, lambda p: p["published"] != p["reduced"]))
    first = F.slice(F.array_sort(F.flatten(F.collect_list(F.slice("differ", 1, EXAMPLES)))), 1, EXAMPLES)
    told = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("width") - 1).alias("cells"), F.sum(F.size("differ")).cast("long").alias("wrong"), first.alias("examples"))

    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = facts.join(told, "case_id", "left")
    agreed = F.col("header_matches") & (F.coalesce("wrong", F.lit(0)) == 0) & (F.coalesce("rows", F.lit(0)) == F.col("expected_rows")) & (F.coalesce("contradicted", F.lit(0)) == 0)
    examples = F.coalesce(F.transform("examples", lambda e: F.struct(e["row"].alias("row"), e["name"].alias("name"), e["published"].alias("published"), e["reduced"].alias("reduced"))), F.array().cast("array<struct<row:int,name:string,published:string,reduced:string>>"))
    return out.select(
        "case_id", F.when(agreed, "reproduced").otherwise("disagreed").alias("outcome"), "header_matches", none("rows"), "expected_rows", F.when(F.col("header_matches"), F.size("header") - 1).otherwise(0).cast("long").alias("columns"),
        none("cells"), none("wrong"), examples.alias("examples"), *[none(c) for c in ("seen", "by_id", "by_template", "dropped", "masked", "contradicted")], "lowest", "highest",
    )


def bound(published: DataFrame, logs: DataFrame) -> DataFrame:
    """One row for each case with a published table whose log rows name no cluster: (case_id, outcome,
    reason, pairs, over, unreadable, tightest, published_total, published_rows, columns, cells, log_rows).

    pairs are containers and buckets with a published count, over those whose sum is above the log
    rows of the container in the bucket, tightest the least that any has to spare. outcome is bounded,
    disagreed (a pair is over, or a time or cell is no whole number from 0 on: unreadable), or
    refused, with a reason: unreadable-header (it does not begin with time), unreadable-column (no
    container_number), off-grid-table (a time that no bucket begins with), no-published-cells. An empty
    cell is 0. Refused cases have only their reason.
    """
    header, body = _lines(published)
    names = F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(0)))
    of = F.transform(names, lambda c: F.regexp_extract(c, "^(.+)_([0-9]+)$", 1))
    facts = header.select("case_id", of.alias("containers"), F.when(F.coalesce(F.get("header", F.lit(0)), F.lit("")) != "time", "unreadable-header").when(F.exists(of, lambda c: c == ""), "unreadable-column").alias("refused"))
    whole = r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$"
    number = lambda c: F.when(c.rlike(whole), F.regexp_extract(c, r"[+-]?[0-9]+", 0).try_cast("long"))
    rows = body.join(facts.where("refused IS NULL").drop("refused"), "case_id").withColumn("time", number(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    on_grid = F.col("time").isNotNull() & (F.pmod("time", F.lit(SECONDS)) == 0)
    value = lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(number(c))
    cells = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c, i: F.struct(F.get("containers", i).alias("container"), value(c).alias("n")))
    rows = rows.withColumn("cells", F.when(on_grid, cells).otherwise(F.array().cast("array<struct<container:string,n:bigint>>")))
    bad = F.size(F.filter("cells", lambda c: F.coalesce(c["n"] < 0, F.lit(True)))) + F.col("time").isNull().cast("int")
    read = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("published_rows"), F.sum(bad).alias("unreadable"), F.max(F.col("time").isNotNull() & ~on_grid).alias("off_grid"))
    each = rows.select("case_id", F.col("time").alias("bucket"), F.explode("cells").alias("c")).where("c.n > 0").groupBy("case_id", "c.container", "bucket").agg(F.sum("c.n").alias("published"), F.count(F.lit(1)).alias("cells"))
    held = logs.groupBy("case_id", "container", bucket(F.col("at_seconds")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spare = F.coalesce("n", F.lit(0)) - F.col("published")
    pairs = each.join(held, ["case_id", "container", "bucket"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum((spare < 0).cast("long")).alias("over"), F.min(spare).alias("tightest"), F.sum("published").alias("published_total"), F.sum("cells").alias("cells"))
    size = held.groupBy("case_id").agg(F.sum("n").alias("log_rows"))
    out = facts.join(read, "case_id", "left").join(pairs, "case_id", "left").join(size, "case_id", "left")
    reason = F.coalesce("refused", F.when(F.col("off_grid"), "off-grid-table").when(F.col("pairs").isNull(), "no-published-cells"))
    told = lambda c: F.when(F.col("reason").isNull(), F.coalesce(F.col(c), F.lit(0))).alias(c)
    outcome = F.when(F.col("reason").isNotNull(), "refused").when((F.col("over") > 0) | (F.col("unreadable") > 0), "disagreed").otherwise("bounded")
    return out.withColumn("reason", reason).withColumn("columns", F.size("containers").cast("long")).select("case_id", outcome.alias("outcome"), "reason", *[told(c) for c in ("pairs", "over", "unreadable", "tightest", "published_total", "published_rows", "columns", "cells", "log_rows")])
