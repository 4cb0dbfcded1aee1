"""Generated JSON documents from spark.range: seeded, so that they come out the same each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.functions.registry import Registry

#: What generated members are drawn from.
CATEGORIES = ["Electronics", "Books", "Clothing", "Home", "Sports"]
TAGS = ["new", "sale", "popular", "limited", "classic", "premium", "eco", "import"]
GENRES = ["Drama", "Comedy", "Crime", "Action", "Documentary"]
NAMES = ["Ada Lovelace", "Alan Turing", "Grace Hopper", "Edsger Dijkstra", "Barbara Liskov", "Donald Knuth"]
DEPARTMENTS = ["Engineering", "Sales", "Marketing", "Finance", "Legal", "Support", "Design", "Research", "Security", "Operations", "People", "Data"]
TEXTS = ["A reliable choice for streaming analytics", "Built for daily work", "An award winning classic", "Stream data pipelines with ease"]
STATUSES = ["pending", "shipped", "delivered", "returned"]


def pick(values: list, k: Column, seed: int, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(k, F.lit(seed), F.lit(salt)), F.lit(len(values))).cast("int") + 1)


def number(k: Column, seed: int, salt: int, low: int, high: int) -> Column:
    return (F.pmod(F.xxhash64(k, F.lit(seed), F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")


def day(k: Column, seed: int, salt: int) -> Column:
    return F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), number(k, seed, salt, 0, 1800)), "yyyy-MM-dd")


def _id(prefix: str, k: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(k.cast("string"), 6, "0"))


def _rows(spark: SparkSession, n: int, member: Callable[[Column], list[Column]]) -> DataFrame:
    """k, from 0, and json."""
    return spark.range(int(n)).select(F.col("id").alias("k"), F.to_json(F.struct(*member(F.col("id")))).alias("json"))


def ecommerce(spark: SparkSession, n: int, seed: int) -> dict[str, DataFrame]:
    def product(k: Column) -> list[Column]:
        return [
            _id("prod-", k).alias("id"),
            F.concat(pick(CATEGORIES, k, seed, 1), F.lit(" item "), k.cast("string")).alias("name"),
            (number(k, seed, 2, 100, 99999) / 100).alias("price"),
            pick(CATEGORIES, k, seed, 1).alias("category"),
            (number(k, seed, 3, 0, 1) == 1).alias("inStock"),
            number(k, seed, 4, 1, 5).alias("rating"),
            number(k, seed, 5, 0, 500).alias("reviewCount"),
            _id("SKU", k).alias("sku"),
            (number(k, seed, 6, 1, 500) / 10).alias("weight"),
            F.array(pick(TAGS, k, seed, 7), pick(TAGS, k, seed, 8)).alias("tags"),
            day(k, seed, 9).alias("createdAt"),
        ]

    def review(k: Column) -> list[Column]:
        return [
            _id("rev-", k).alias("id"),
            _id("prod-", number(k, seed, 1, 0, max(0, n - 1))).alias("productId"),
            number(k, seed, 2, 1, 5).alias("rating"),
            pick(TEXTS, k, seed, 3).alias("title"),
            pick(TEXTS, k, seed, 4).alias("comment"),
            pick(NAMES, k, seed, 5).alias("author"),
            (number(k, seed, 6, 0, 1) == 1).alias("verified"),
            number(k, seed, 7, 0, 99).alias("helpful"),
            day(k, seed, 8).alias("date"),
        ]

    def order(k: Column) -> list[Column]:
        item = F.struct(
            _id("prod-", number(k, seed, 2, 0, max(0, n - 1))).alias("productId"),
            number(k, seed, 3, 1, 5).alias("quantity"),
            (number(k, seed, 4, 100, 9999) / 100).alias("unitPrice"),
        )
        address = F.struct(F.lit("Springfield").alias("city"), F.lit("IL").alias("state"), number(k, seed, 7, 10000, 99999).cast("string").alias("zip"))
        return [
            _id("ord-", k).alias("id"),
            _id("cust-", number(k, seed, 1, 0, 999)).alias("customerId"),
            F.array(item).alias("items"),
            (number(k, seed, 5, 100, 99999) / 100).alias("total"),
            pick(STATUSES, k, seed, 6).alias("status"),
            address.alias("shippingAddress"),
            day(k, seed, 8).alias("createdAt"),
        ]

    return {"products": _rows(spark, n, product), "reviews": _rows(spark, n * 3 // 2, review), "orders": _rows(spark, n * 4 // 5, order)}


def movies(spark: SparkSession, n: int, seed: int) -> dict[str, DataFrame]:
    def show(k: Column) -> list[Column]:
        return [
            _id("show-", k).alias("id"),
            F.concat(F.lit("Show "), k.cast("string")).alias("title"),
            number(k, seed, 1, 1950, 2024).alias("year"),
            F.array(pick(GENRES, k, seed, 2)).alias("genre"),
            (number(k, seed, 3, 10, 100) / 10).alias("rating"),
            number(k, seed, 4, 0, 99999).alias("votes"),
            number(k, seed, 5, 60, 240).alias("runtime"),
            F.array(pick(NAMES, k, seed, 6), pick(NAMES, k, seed, 7)).alias("cast"),
            pick(NAMES, k, seed, 8).alias("director"),
            pick(TEXTS, k, seed, 9).alias("description"),
            F.lit("en").alias("language"),
            F.lit("US").alias("country"),
            day(k, seed, 10).alias("releaseDate"),
        ]

    def review(k: Column) -> list[Column]:
        return [
            _id("rev-", k).alias("id"),
            _id("show-", number(k, seed, 1, 0, max(0, n - 1))).alias("showId"),
            pick(NAMES, k, seed, 2).alias("author"),
            number(k, seed, 3, 1, 10).alias("score"),
            pick(TEXTS, k, seed, 4).alias("headline"),
            pick(TEXTS, k, seed, 5).alias("body"),
            day(k, seed, 6).alias("date"),
            (number(k, seed, 7, 0, 1) == 1).alias("spoilers"),
        ]

    return {"shows": _rows(spark, n, show), "reviews": _rows(spark, 2 * n, review)}


def blog(spark: SparkSession, n: int, seed: int) -> dict[str, DataFrame]:
    authors = max(10, n // 10)

    def author(k: Column) -> list[Column]:
        return [_id("author-", k).alias("id"), pick(NAMES, k, seed, 1).alias("name"), pick(TEXTS, k, seed, 2).alias("bio")]

    def post(k: Column) -> list[Column]:
        return [
            _id("post-", k).alias("id"),
            _id("author-", number(k, seed, 1, 0, authors - 1)).alias("authorId"),
            pick(TEXTS, k, seed, 2).alias("title"),
            pick(TEXTS, k, seed, 3).alias("body"),
            F.array(pick(TAGS, k, seed, 4)).alias("tags"),
            day(k, seed, 5).alias("publishedAt"),
        ]

    def comment(k: Column) -> list[Column]:
        return [
            _id("com-", k).alias("id"),
            _id("post-", number(k, seed, 1, 0, max(0, n - 1))).alias("postId"),
            pick(NAMES, k, seed, 2).alias("author"),
            pick(TEXTS, k, seed, 3).alias("text"),
        ]

    return {"authors": _rows(spark, authors, author), "posts": _rows(spark, n, post), "comments": _rows(spark, n * 3 // 2, comment)}


def employees(spark: SparkSession, n: int, seed: int) -> dict[str, DataFrame]:
    def department(k: Column) -> list[Column]:
        return [_id("dept-", k).alias("id"), F.element_at(F.array(*map(F.lit, DEPARTMENTS)), k.cast("int") + 1).alias("name")]

    def employee(k: Column) -> list[Column]:
        return [
            _id("emp-", k).alias("id"),
            pick(NAMES, k, seed, 1).alias("name"),
            _id("dept-", number(k, seed, 2, 0, 11)).alias("departmentId"),
            number(k, seed, 3, 40000, 200000).alias("salary"),
            F.when(k > 9, _id("emp-", number(k, seed, 4, 0, 9))).alias("manager"),
            day(k, seed, 5).alias("hiredAt"),
        ]

    return {"departments": _rows(spark, len(DEPARTMENTS), department), "employees": _rows(spark, n, employee)}


def catalog(spark: SparkSession, n: int, seed: int = 0) -> dict[str, DataFrame]:
    """The flat objects that the benchmarks read: a pure function of their number."""

    def nth(values: list[str], k: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)

    def item(k: Column) -> list[Column]:
        return [
            k.alias("id"),
            F.concat(F.lit("Item "), k.cast("string")).alias("name"),
            nth(CATEGORIES, k).alias("category"),
            nth(TEXTS, k).alias("description"),
            F.array(*(nth(TAGS, k + j) for j in range(3))).alias("tags"),
            (k % 5 + 1).cast("int").alias("rating"),
            (k % 7 == 0).alias("featured"),
        ]

    return {"items": _rows(spark, n, item)}


GENERATORS = Registry("generator", ecommerce=ecommerce, movies=movies, blog=blog, employees=employees, catalog=catalog)


def generate(spark: SparkSession, kind: str, n: int, *, seed: int = 42, strict: bool = True) -> dict[str, DataFrame]:
    """Collection -> rows (k, json). An unknown kind raises, or is ecommerce if not strict."""
    return GENERATORS.get(kind if strict or kind in GENERATORS.names() else "ecommerce")(spark, n, seed)


def record_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """collection and n_records."""
    parts = [df.agg(F.lit(name).alias("collection"), F.count("*").alias("n_records")) for name, df in collections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def documents(rows: DataFrame, collection: str, per_document: int, *, path: str = "") -> DataFrame:
    """doc_id and content: documents of so many objects each, under the names of path and then collection."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "json"))), lambda x: x["json"])
    grouped = rows.groupBy(F.floor(F.col("k") / per_document).alias("doc_id")).agg(F.array_join(ordered, ",").alias("_j"))
    names = [*(p for p in path.split(".") if p), collection]
    head = "".join('{"' + p + '":' for p in names)
    return grouped.select("doc_id", F.concat(F.lit(head + "["), "_j", F.lit("]" + "}" * len(names))).cast("binary").alias("content"))

#: Per generator: fields that hold words, and beginnings of words that occur in them.
SUGGESTED = {
    "ecommerce": (["name", "category", "tags"], ["elec", "book", "popu"]),
    "movies": (["title", "cast", "description", "genre"], ["show", "dram", "class"]),
    "blog": (["title", "body", "tags"], ["stream", "reli", "eco"]),
    "employees": (["name", "departmentId"], ["grace", "dept"]),
    "catalog": (["name", "category", "description", "tags"], ["stream", "book", "prem"]),
}


def suggestions(kind: str) -> dict[str, list[str]]:
    """fields and terms to try on a generator's data; those of ecommerce for an unknown kind. Its paths are generate()'s keys."""
    fields, terms = SUGGESTED.get(kind, SUGGESTED["ecommerce"])
    return {"fields": list(fields), "terms": list(terms)}
