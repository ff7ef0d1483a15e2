"""Catalogue search through an inverted index of character trigrams (§2 B4).

The index maps every three-character piece of a lower-cased text to the key of its
row: product titles to product ids, seller labels to seller ids (so a renamed seller
is one changed text, however many products it sells).  A text that contains the
searched text contains all of its pieces, so the keys under a few of its rarest pieces
are a superset of the answer, and the exact literal test on those rows decides.

* **Layout.**  Postings are rows (folder, piece, key), sorted, in folders by a hash of
  the piece: a search opens only the folders of its pieces, and inside them the row
  groups whose bounds admit them.  They are dealt by ranges of (folder, piece, key), so
  a piece that every text holds is spread over tasks and files.
* **Changes.**  New and changed texts are appended under a batch number
  (``sources.versions.append_batch``); the same batch again writes the same folder.
  Postings of a former text stay: they can only add a candidate that the exact test
  then drops, never lose one.  ``compact`` drops them by writing the index anew.
* **Fallback.**  A searched text of fewer than three characters has no piece and takes
  the scan of ``catalog``.

Defined results: null texts have no postings; an empty or null index gives no rows;
``%`` and ``_`` are ordinary characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escrowlens.functions import labels as L
from escrowlens.operators import catalog as c
from escrowlens.session import scratch_path
from escrowlens.sources.versions import append_batch, batches_in, remove

Tables = dict[str, DataFrame]

SIZE = 3          # characters of a piece
FOLDERS = 64      # folders of postings; more for more distinct pieces
PROBED = 4        # pieces whose postings are intersected, the rarest ones
LOOKED_UP = 64    # pieces of a long searched text whose counts are looked up
FEW = 2_000       # up to so many found products their ids go into the scans as values


def pieces(text: Column) -> Column:
    """The distinct three-character pieces of a lower-cased text (none if shorter or null)."""
    last = F.char_length(text) - (SIZE - 1)
    each = F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(text, at, F.lit(SIZE)))
    return F.array_distinct(F.when(last >= 1, each).otherwise(F.array().cast("array<string>")))


def pieces_of(text: str) -> list[str]:
    return list(dict.fromkeys(text[i:i + SIZE] for i in range(len(text) - SIZE + 1)))


def _folder(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(FOLDERS)).cast("int")


def titles(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").cast("string").alias("key"), F.lower("title").alias("text"))


def sellers(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("id").alias("key"),
                           F.lower(L.seller_label("username", "full_name")).alias("text"))


class TextIndex:
    """The postings of one text column below ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def add(self, texts: DataFrame, batch_id: int) -> None:
        """Append the postings of ``texts`` (key, text); a repeated batch replaces itself."""
        rows = texts.filter("key is not null and text is not null").select(
            "key", F.explode(pieces(F.col("text"))).alias("piece"))
        rows = rows.select(_folder(F.col("piece")).alias("folder"), "piece", "key")
        where = f"{self.base}/postings/b={batch_id}"
        (rows.repartitionByRange("folder", "piece", "key").sortWithinPartitions("folder", "piece", "key")
         .write.mode("overwrite").partitionBy("folder").parquet(where))
        written = self.spark.read.schema("piece string, key string, folder int").parquet(where)
        counts = written.groupBy("folder", "piece").agg(F.count(F.lit(1)).alias("n"))
        append_batch(counts.repartitionByRange("folder", "piece"), f"{self.base}/counts", batch_id)

    def _read(self, kind: str, schema: str) -> DataFrame | None:
        # A batch counts from the moment its counts are written, after its postings.
        folders = [f"{self.base}/{kind}/b={b}" for b in batches_in(self.spark, f"{self.base}/counts")]
        if not folders:
            return None
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rarest(self, text: str) -> list[str] | None:
        """Up to PROBED of the rarest pieces of ``text``; None if some piece occurs nowhere."""
        asked = pieces_of(text)
        step = -(-len(asked) // LOOKED_UP)
        asked = asked[::step]
        counts = self._read("counts", "folder int, piece string, n long")
        if counts is None:
            return None
        here = counts.filter(F.col("piece").isin(asked)).groupBy("piece").agg(F.sum("n").alias("n"))
        found = sorted((r["n"], r["piece"]) for r in here.collect())   # at most LOOKED_UP rows
        if len(found) < len(asked):
            return None
        return [p for _, p in found[:PROBED]]

    def candidates(self, text: str) -> DataFrame:
        """Keys (distinct) of the texts that may contain ``text`` (lower-cased, 3 characters or more)."""
        asked = self.rarest(text)
        nothing = self.spark.createDataFrame([], "key string")
        if asked is None:
            return nothing
        hashed = self.spark.range(1).select(*[_folder(F.lit(p)) for p in asked]).first()
        folders = sorted(set(hashed))
        rows = self._read("postings", "piece string, key string, folder int")
        rows = rows.filter(F.col("folder").isin(folders) & F.col("piece").isin(asked))
        if len(asked) == 1:
            return rows.select("key").distinct()
        # One bit per piece: a partial aggregate of four bits per key, not a set.
        bit = F.lit(0)
        for at, piece in enumerate(asked):
            bit = F.when(F.col("piece") == piece, F.lit(1 << at)).otherwise(bit)
        return rows.groupBy("key").agg(F.bit_or(bit).alias("_seen")) \
            .filter(F.col("_seen") == (1 << len(asked)) - 1).select("key")

    def compact(self, texts: DataFrame) -> TextIndex:
        """A new index of the current texts, without postings of former ones."""
        fresh = TextIndex(self.spark, scratch_path(self.spark, "text-index"))
        fresh.add(texts, 0)
        return fresh

    def drop(self) -> None:
        remove(self.spark, self.base)


class CatalogIndex:
    """Title and seller indexes of the catalogue, and the search through them."""

    def __init__(self, title: TextIndex, seller: TextIndex):
        self.title, self.seller = title, seller

    @classmethod
    def build(cls, t: Tables) -> CatalogIndex:
        spark = t["products"].sparkSession
        made = cls(*[TextIndex(spark, scratch_path(spark, f"{kind}-index")) for kind in ("title", "seller")])
        made.add(0, t["products"], t["profiles"])
        return made

    def add(self, batch_id: int, products: DataFrame | None = None,
            profiles: DataFrame | None = None) -> None:
        """Index new or changed products and profiles (rows as they are now)."""
        if products is not None:
            self.title.add(titles(products), batch_id)
        if profiles is not None:
            self.seller.add(sellers(profiles), batch_id)

    def compact(self, t: Tables) -> CatalogIndex:
        return CatalogIndex(self.title.compact(titles(t["products"])), self.seller.compact(sellers(t["profiles"])))

    def found(self, t: Tables, text: str) -> DataFrame:
        """Products of the active catalogue whose title or seller label contains ``text`` (lower-cased)."""
        may = self.seller.candidates(text).withColumnRenamed("key", "id")
        who = t["profiles"].join(may, "id", "left_semi").filter(
            F.lower(L.seller_label("username", "full_name")).contains(text)).select(F.col("id").alias("seller_id"))
        p = c.catalog_scan(t)
        by_title = p.join(self.title.candidates(text).select(F.col("key").cast("bigint").alias("id")), "id",
                          "left_semi").filter(F.lower("title").contains(text))
        by_seller = p.join(who, "seller_id", "left_semi").filter(
            ~F.coalesce(F.lower("title").contains(text), F.lit(False)))
        # The label of a product without a known seller is a constant, in no index.
        rest = p.join(t["profiles"].select(F.col("id").alias("seller_id")), "seller_id", "left_anti").filter(
            ~F.coalesce(F.lower("title").contains(text), F.lit(False))) \
            if text in L.DEFAULT_SELLER_NAME.lower() else None
        out = by_title.unionByName(by_seller)
        return out if rest is None else out.unionByName(rest)

    def search(self, t: Tables, search: str, category: str | None = None, sub: str | None = None,
               sort: str = "latest", limit: int | None = None, trim_search: bool = False) -> DataFrame:
        """The rows of ``catalog`` with the same arguments, found through the index."""
        typed = search.strip() if trim_search else search
        text = typed.lower()
        if len(text) < SIZE:
            return c.catalog(t, category=category, sub=sub, search=search, sort=sort, limit=limit,
                             trim_search=trim_search)
        p = self.found(t, text)
        if sub:
            category = "game"
            p = p.filter(F.col("subcategory") == sub)
        if category:
            p = p.filter(F.col("category") == category)
        return c.cards_of(t, p, sort, limit, few=FEW)
