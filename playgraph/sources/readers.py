"""Sources: SQL dumps, JSON features, credits, labels, JDBC, text pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What a backslash escape in a dump stands for.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}


def split_values(line: str) -> list[list[str | None]]:
    """The tuples of one INSERT line, every field as text, NULL as None. A scanner that jumps from quote to quote: within a
    string only a backslash or a quote is of interest; a doubled quote is one quote."""
    at = line.upper().find("VALUES")
    rows: list[list[str | None]] = []
    if at < 0:
        return rows
    i, n = at + 6, len(line)
    while (i := line.find("(", i)) >= 0:
        row: list[str | None] = []
        i += 1
        while i < n:
            while i < n and line[i] in " \t":
                i += 1
            if i < n and line[i] == "'":
                part, i = [], i + 1
                while i < n:
                    j = i
                    while j < n and line[j] not in "'\\":
                        j += 1
                    part.append(line[i:j])
                    if j >= n:
                        i = n
                    elif line[j] == "\\":
                        part.append(ESCAPES.get(line[j + 1 : j + 2], line[j + 1 : j + 2]))
                        i = j + 2
                    elif line[j + 1 : j + 2] == "'":
                        part.append("'")
                        i = j + 2
                    else:
                        i = j + 1
                        break
                row.append("".join(part))
                while i < n and line[i] not in ",)":
                    i += 1
            else:
                j = i
                while j < n and line[j] not in ",)":
                    j += 1
                raw = line[i:j].strip()
                row.append(None if raw.upper() == "NULL" else raw)
                i = j
            if i < n and line[i] == ",":
                i += 1
                continue
            i += 1
            break
        rows.append(row)
    return rows


def read_dump(spark: SparkSession, path: str, table: str, columns: list[tuple[str, int, str]]) -> DataFrame:
    """SRC-01, SRC-02: a table of a MySQL dump. ``columns``: (name, position, Spark type). Files split by line over tasks; lines
    of other tables are dropped before any parsing; values that don't fit their type are null."""
    lines = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO `{table}`"))
    at = [p for _, p, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for line in b.column(0).to_pylist():
                rows = split_values(line)
                cols = [pa.array([r[p] if p < len(r) else None for r in rows], pa.string()) for p in at]
                yield pa.RecordBatch.from_arrays(cols, names=[c for c, _, _ in columns])

    raw = lines.mapInArrow(run, T.StructType([T.StructField(c, T.StringType()) for c, _, _ in columns]))
    return raw.select(*[F.col(c) if t == "string" else F.expr(f"try_cast(`{c}` as {t})").alias(c) for c, _, t in columns])


def typed_entries(raw: DataFrame) -> DataFrame:
    """FLT-02: texts default to '', a release id that is no number to 0."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("artist_name", "song_title", "release_title", "label_name") if c in raw.columns}
    out = raw.withColumns(text)
    return out.withColumn("library_release_id", F.coalesce(F.expr("try_cast(library_release_id as bigint)"), F.lit(0))) if "library_release_id" in raw.columns else out


def music_entries(entries: DataFrame, first_other_code: int = 7) -> DataFrame:
    """FLT-01: entries that are music by their type code, pushed down to the scan."""
    return entries.where(F.col("entry_type_code") < first_other_code)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, fetch: int = 10_000) -> DataFrame:
    """SRC-03: a relational table with a server-side cursor of ``fetch`` rows, split on a numeric column if given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch)
    if partition:
        column, low, high, n = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return r.load()


def enrichment_lookup(names: DataFrame, facts: DataFrame, name: str = "artist_name") -> DataFrame:
    """SRC-04: facts of the names asked for, by lower-case name; one semi-join, no batching."""
    return facts.join(names.select(F.lower(name).alias("_k")).distinct(), F.lower(facts[name]) == F.col("_k"), "left_semi")


def search_artist(queries: DataFrame, primary: DataFrame, track_credits: DataFrame) -> DataFrame:
    """SRC-05: (artist_name, title) -> artist_id by a primary credit of a release of that title, else by a track credit; the
    smallest id where several fit."""
    key = [F.lower("artist_name").alias("a"), F.lower("title").alias("t")]
    p = primary.select(*key, "artist_id").groupBy("a", "t").agg(F.min("artist_id").alias("p"))
    c = track_credits.select(*key, "artist_id").groupBy("a", "t").agg(F.min("artist_id").alias("c"))
    q = queries.withColumn("a", F.lower("artist_name")).withColumn("t", F.lower("title"))
    return q.join(p, ["a", "t"], "left").join(c, ["a", "t"], "left").withColumn("artist_id", F.coalesce("p", "c")).drop("a", "t", "p", "c")


def assemble_releases(releases: DataFrame, artists: DataFrame, labels: DataFrame, tracks: DataFrame) -> DataFrame:
    """SRC-06: release header with nested artists, labels and tracklist, each in order."""
    nest = lambda df, cols, name: df.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = releases
    for df, cols, name in ((artists, ["name", "artist_id", "role"], "artists"), (labels, ["name", "label_id", "catno"], "labels"), (tracks, ["position", "title"], "tracklist")):
        out = out.join(nest(df, cols, name), "release_id", "left")
    return out


def kb_influences(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """SRC-07: influence pairs with well-formed ids, the name from the label table, else the id itself."""
    ok = pairs.where(F.col("source_qid").rlike(r"^Q\d+$") & F.col("target_qid").rlike(r"^Q\d+$"))
    lab = labels.select(F.col("qid").alias("target_qid"), "label")
    return ok.join(lab, "target_qid", "left").select("source_qid", "target_qid", F.coalesce("label", "target_qid").alias("target_name")).distinct()


def kb_hierarchy(parent_of: DataFrame, child_of: DataFrame) -> DataFrame:
    """SRC-07: (parent, child) from both directions in which it may be stated."""
    return parent_of.select("parent", "child").unionByName(child_of.select("parent", "child")).distinct()


def recordings_of(gids: DataFrame, artists: DataFrame, recordings: DataFrame) -> DataFrame:
    """SRC-08: artist gid -> sorted recording ids."""
    j = gids.join(artists, "gid").join(recordings, "artist_id")
    return j.groupBy("gid").agg(F.array_sort(F.collect_set("mbid")).alias("recordings"))


CLASSIFIERS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))


def parse_distributions(df: DataFrame, column: str) -> DataFrame:
    """SRC-09, JSN-03: the JSON of classifier -> label -> probability as nested maps; broken JSON is null."""
    return df.withColumn(column, F.from_json(column, CLASSIFIERS))


def read_feature_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-10: one JSON file a record, found recursively, with its id from the file name; broken files are left out."""
    df = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "DROPMALFORMED").schema(schema).json(path)
    return df.withColumn("record_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(-\d+)?\.json$", 1))


def track_credits(df: DataFrame, column: str) -> DataFrame:
    """SRC-14: [{comp_id, tracks: [{title, artists[]}]}] as (release_id, track_title, artist_name, id); the first artist of each
    track, tracks without one left out."""
    shape = "array<struct<comp_id: bigint, tracks: array<struct<title: string, artists: array<string>>>>>"
    comps = df.select(F.explode(F.from_json(column, shape)).alias("c"))
    tracks = comps.select("c.comp_id", F.posexplode("c.tracks").alias("pos", "t"))
    return tracks.where(F.size("t.artists") > 0).select(F.col("comp_id").alias("release_id"), F.col("t.title").alias("track_title"), F.col("t.artists")[0].alias("artist_name"), F.col("pos").cast("long").alias("id"))


def read_label_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: JSON lines or CSV with a header; rows without a row_id are skipped."""
    df = spark.read.option("header", "true").csv(path) if path.endswith(".csv") else spark.read.json(path)
    return df.where("row_id is not null and trim(row_id) <> ''")


def identity_import(identities: DataFrame) -> DataFrame:
    """SRC-13: identities that have been reconciled, the last per name (by status, then id)."""
    w = Window.partitionBy("library_name").orderBy(F.desc("status"), F.desc_nulls_last("external_id"))
    return identities.where("status <> 'unreconciled'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_identities(artists: DataFrame, entities: DataFrame, identities: DataFrame, artist_ids: list[str], entity_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-13: (artists, entities) after reconciled ``identities`` (library_name, status, ids) came in: a non-null new id
    replaces the artist's, a null one leaves it; the artist takes the identity's status. An identity with any of ``entity_ids``
    goes to the artist's entity in the same way; an artist without an entity gets a new one, numbered after the largest in
    name order. Names are matched exactly; artists without an identity stay as they are."""
    from playgraph.sources.sinks import assign_ids

    i = identities.select(F.col("library_name").alias("canonical_name"), F.col("status").alias("_status"), *[F.col(c).alias(f"_{c}") for c in [*artist_ids, *entity_ids]])
    j = artists.join(i, "canonical_name", "left")
    j = j.withColumns({c: F.coalesce(f"_{c}", c) for c in artist_ids}).withColumn("status", F.coalesce("_status", "status"))
    some = F.coalesce(*[F.col(f"_{c}").cast("string") for c in entity_ids]).isNotNull()
    fresh = j.where(some & F.col("entity_id").isNull()).select(F.col("canonical_name").alias("name"), *[F.col(f"_{c}").alias(c) for c in entity_ids])
    numbered = assign_ids(fresh, "name", entities.select("id", "name")).join(fresh, "name")
    new = numbered.join(entities.select("id"), "id", "left_anti").select("id", "name", *entity_ids)
    j = j.join(new.select(F.col("id").alias("_new"), F.col("name").alias("canonical_name")), "canonical_name", "left").withColumn("entity_id", F.coalesce("entity_id", "_new"))
    # several artists of one entity: the first by name that brings an id
    came = j.where(some & F.col("_new").isNull()).groupBy(F.col("entity_id").alias("id")).agg(*[F.min_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("canonical_name"))).alias(f"_{c}") for c in entity_ids])
    kept = entities.join(came, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in entity_ids}).select("id", "name", *entity_ids)
    return j.select(*artists.columns), kept.unionByName(new)


def cached(spark: SparkSession, path: str, build, root: str | None = None) -> DataFrame:
    """SRC-16: what ``build()`` makes of the file or folder at ``path``, kept as Parquet in the shared folder under its path,
    size and time of change: as long as these stay, later runs read the kept table; another size or time builds anew. A
    broken-off build leaves no success mark and counts for nothing."""
    from playgraph.session import shared_dir

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size, at = fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()
    key = hashlib.sha256(f"{p.toString()}|{size}|{at}".encode()).hexdigest()[:32]
    to = f"{root or shared_dir(spark)}/kept-{key}"
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}/_SUCCESS")):
        build().write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
