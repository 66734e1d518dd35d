"""Token counts kept up to date by deltas: signed changes, additive totals, idempotent batch commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import join_spread, scratch_dir

DIMENSIONS = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """Signed (source, lang, tokenizer, n_docs, n_tokens) of changes (op, source, lang, tokenizer, tokens, old_tokens).

    insert adds a document and its tokens, delete takes both back, revise adds tokens minus old_tokens. A null count
    is 0. Null dimensions are kept as values of their own. Another op, or none, raises. Rows that are repeated count as
    often as they come; further columns are ignored; no rows give no rows.
    """
    zero = F.lit(0).cast("long")
    now, was = F.coalesce(F.col("tokens").cast("long"), zero), F.coalesce(F.col("old_tokens").cast("long"), zero)
    bad = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(bad)
    tokens = F.when(F.col("op") == "insert", now).when(F.col("op") == "delete", -now).otherwise(now - was)
    return changes.select(*DIMENSIONS, docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"))


def rolled(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*DIMENSIONS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


class TokenRollups:
    """Totals under a shared folder: small deltas per batch, and a marker that names the batch.

    A batch is reduced to one row per source, language and tokenizer version before it is written, combined before
    the shuffle, so a source with most of the rows costs one row per task. commit() writes them to a folder of its
    own and then moves a marker, which names the folder, to the batch's name without overwriting: of two writers of a
    batch one gets True, and a job that dies half-way leaves nothing that totals() reads. The file system has to
    refuse a move onto an existing file, as HDFS does. compact() writes the sums of all batches so far as one folder
    and names the batches in it by a marker of the same kind; their own markers stay, so late repeats have no effect.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._jvm = jvm.org.apache.hadoop.fs.Path, jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        where = self._fs.makeQualified(self._path(self.path))
        self.path = where.toString()
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if not s.getPath().getName().startswith(".")) if self._fs.exists(at) else []

    def _read(self, marker: str) -> dict:
        import json

        stream = self._fs.open(self._path(f"{self.path}/{marker}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _mark(self, marker: str, content: dict) -> bool:
        """Put a marker there whole, if there is none; False if there is."""
        import json
        import uuid

        from py4j.protocol import Py4JJavaError

        temporary, target = self._path(f"{self.path}/_writing/{uuid.uuid4().hex}"), self._path(f"{self.path}/{marker}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(temporary, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._files.rename(temporary, target, options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, True)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _write(self, rows: DataFrame) -> str:
        import uuid

        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/data/{name}"), True)

    def batches(self) -> list[str]:
        """Names of committed batches, compacted ones included."""
        return self._names("batches")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been committed before. An empty batch commits with no rows."""
        import re

        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"batch name: {batch!r}")
        if self._fs.exists(self._path(f"{self.path}/batches/{batch}")):
            return False
        data = self._write(rolled(signed(changes)))
        if self._mark(f"batches/{batch}", {"data": data}):
            return True
        self._drop(data)
        return False

    def _state(self) -> tuple[dict, dict[str, str]]:
        """The last compaction, and the folders of the batches that aren't in it."""
        made = self._names("compactions")
        last = self._read(f"compactions/{made[-1]}") if made else {"data": None, "batches": []}
        return last, {b: self._read(f"batches/{b}")["data"] for b in sorted(set(self.batches()) - set(last["batches"]))}

    def _rows(self, last: dict, open_: dict[str, str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        folders = [x for x in (last["data"], *open_.values()) if x]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{x}" for x in folders])

    def totals(self) -> DataFrame:
        """Additive totals of all committed batches; groups whose documents and tokens are all gone have no row."""
        return rolled(self._rows(*self._state())).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold the batches so far into one folder; False if there was none to fold or another writer came first.

        Folders that the compaction before this one had replaced are deleted: totals read until then stay readable.
        """
        made = self._names("compactions")
        last, open_ = self._state()
        if not open_:
            return False
        data = self._write(rolled(self._rows(last, open_)).coalesce(1))
        gone = [x for x in (last["data"], *open_.values()) if x]
        if not self._mark(f"compactions/{len(made):08d}", {"data": data, "batches": sorted([*last["batches"], *open_]), "replaced": gone}):
            self._drop(data)
            return False
        for name in last.get("replaced", []):
            self._drop(name)
        return True


def scratch_rollups(spark: SparkSession) -> TokenRollups:
    import uuid

    return TokenRollups(spark, f"{scratch_dir(spark).rstrip('/')}/rollups-{uuid.uuid4().hex}")


def document_changes(docs: DataFrame, words: Column, chars: Column) -> dict[str, DataFrame]:
    """The change feed of a table of documents as batches.

    load inserts all documents under both tokenizer versions, words-1 with a quarter of the stated characters for an
    estimate; recount revises every estimate to the counted words; dedup deletes documents whose text a smaller
    doc_id has. Estimates and counts of null values are 0, and a null text is an empty one. Rows of the least doc_id
    of a text all stay, so repeated rows are counted as often as they come; a null doc_id is neither least nor a copy.
    Further columns are ignored.
    """
    zero = F.lit(0).cast("long")
    estimate = F.coalesce(F.floor(F.col("n_chars") / 4).cast("long"), zero)
    base = docs.select("doc_id", "source", "lang", estimate.alias("estimate"), words.alias("words"), chars.alias("chars"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    none = F.lit(None).cast("long")

    def change(rows: DataFrame, op: str, tokenizer: str, tokens: Column, old: Column = none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), old.alias("old_tokens"))

    first = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = join_spread(base, first, "digest").where("doc_id > first")
    words_, chars_ = F.col("words"), F.col("chars")
    return {
        "load": change(base, "insert", "words-1", F.col("estimate")).union(change(base, "insert", "chars-1", chars_)),
        "recount": change(base, "revise", "words-1", words_, F.col("estimate")),
        "dedup": change(copies, "delete", "words-1", words_).union(change(copies, "delete", "chars-1", chars_)),
    }
