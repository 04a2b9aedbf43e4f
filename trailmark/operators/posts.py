"""Which posts may be published, and what is known about them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import (
    GENESIS_NOINDEX_KEY,
    RANK_MATH_ROBOTS_KEY,
    UNLISTED_TYPE,
    YOAST_NOINDEX_KEY,
    enabled_types,
    supported_types,
)
from trailmark.functions.text import text

TypesHook = Callable[[list[str]], list[str]]


def newest_first() -> list[Column]:
    return [F.desc("post_date"), F.desc("id")]


def with_status(posts: DataFrame, status: str, types: Iterable[str]) -> DataFrame:
    return posts.filter((F.col("post_status") == status) & F.col("post_type").isin(list(types)))


def latest_posts(posts: DataFrame, types: Iterable[str], n: int, status: str = "publish") -> DataFrame:
    """Newest ``n`` posts of the given status and types."""
    return with_status(posts, status, types).orderBy(*newest_first()).limit(n)


def posts_by_id(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts whose id is in ``ids(post_id)``; Spark broadcasts the ids when they are few."""
    return posts.join(ids.select(F.col("post_id").alias("id")), "id", "left_semi")


def per_site_limit(posts: DataFrame, n: int, site: str = "site") -> DataFrame:
    """Newest ``n`` rows of every site.

    Ranked first over slices of a site and then over what is left of them, so that one huge site
    never sorts in a single task, whatever ``n`` is.
    """
    slice_of = F.pmod(F.xxhash64("id"), F.lit(256))
    in_slice = Window.partitionBy(site, "_slice").orderBy(*newest_first())
    sliced = posts.withColumn("_slice", slice_of).withColumn("_rn", F.row_number().over(in_slice))
    posts = sliced.filter(F.col("_rn") <= n).drop("_slice", "_rn")
    in_site = Window.partitionBy(site).orderBy(*newest_first())
    return posts.withColumn("_rn", F.row_number().over(in_site)).filter(F.col("_rn") <= n).drop("_rn")


def noindex(
    flag_a: Column, robots: Column, flag_c: Column, *, flag_a_used: bool = True, robots_used: bool = True
) -> Column:
    """True when any of the three marks asks not to index; unused marks are ignored."""
    marks = F.coalesce(flag_c == "1", F.lit(False))
    if flag_a_used:
        marks = marks | F.coalesce(flag_a == "1", F.lit(False))
    if robots_used:
        marks = marks | F.coalesce(F.array_contains(robots, "noindex"), F.lit(False))
    return marks


def meta_flags(post_meta: DataFrame) -> DataFrame:
    """One row per post from ``post_meta(post_id, key, value)`` rows.

    The robots value is a comma list in storage and an array here.
    """
    keys = (YOAST_NOINDEX_KEY, RANK_MATH_ROBOTS_KEY, GENESIS_NOINDEX_KEY)
    rows = post_meta.filter(F.col("key").isin(*keys))

    def value_of(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value")))

    return rows.groupBy("post_id").agg(
        text(value_of(keys[0])).alias("meta_yoast_noindex"),
        F.split(text(value_of(keys[1])), r"\s*,\s*").alias("meta_rankmath_robots"),
        text(value_of(keys[2])).alias("meta_genesis_noindex"),
    )


def noindex_posts(
    post_meta: DataFrame, *, flag_a_used: bool = True, robots_used: bool = True
) -> DataFrame:
    """Ids of posts marked not to index.

    One mark is enough, so rows are tested where they are and only the few hits are shuffled.
    """
    key, value = F.col("key"), F.col("value")
    marked = (key == GENESIS_NOINDEX_KEY) & (value == "1")
    if flag_a_used:
        marked = marked | ((key == YOAST_NOINDEX_KEY) & (value == "1"))
    if robots_used:
        robots = F.split(value, r"\s*,\s*")
        marked = marked | ((key == RANK_MATH_ROBOTS_KEY) & F.array_contains(robots, "noindex"))
    return post_meta.filter(marked).select("post_id").distinct()


def servable_posts(posts: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Published posts without a password; ``hidden(post_id)`` are the noindex ones."""
    open_posts = posts.filter((F.col("post_status") == "publish") & (F.col("post_password") == ""))
    if hidden is None:
        return open_posts
    return open_posts.join(hidden.select(F.col("post_id").alias("id")), "id", "left_anti")


def allowed_types(
    public: Iterable[str], enabled: Iterable[str] = (), hook: TypesHook | None = None
) -> list[str]:
    """Types that are served: supported ones, narrowed to the enabled, then the hook."""
    types = enabled_types(supported_types(public), enabled)
    return hook(types) if hook else types


def allowed_types_of(enabled: Column, public: Iterable[str]) -> Column:
    """``allowed_types`` where the enabled ones are a comma list per row, in name order."""
    supported = F.array(*map(F.lit, supported_types(public)))
    chosen = F.array_intersect(supported, F.split(enabled, ","))
    return F.array_sort(F.when(text(enabled) != "", chosen).otherwise(supported))


def occurring_types(posts: DataFrame) -> DataFrame:
    """The distinct types of ``posts`` that can be published."""
    return posts.select("post_type").distinct().filter(F.col("post_type") != UNLISTED_TYPE)


def listed_types(public: Iterable[str], hook: TypesHook | None = None) -> list[str]:
    """Types in the index documents: the enabled list plays no part here."""
    types = supported_types(public)
    return hook(types) if hook else types


def type_filter(posts: DataFrame, types: Iterable[str]) -> DataFrame:
    """Posts of the given types. An empty list, left when no enabled type exists, filters nothing."""
    types = list(types)
    return posts.filter(F.col("post_type").isin(types)) if types else posts


def listed_posts(
    posts: DataFrame,
    types: Iterable[str],
    n: int,
    hidden: DataFrame | None = None,
    site: str | None = "site",
) -> DataFrame:
    """Newest ``n`` published posts, then the servable among them: fewer than ``n`` may stay.

    Ranking sorts its rows, so the content is left behind; ``with_content`` fetches it for the
    few posts that are listed.
    """
    published = with_status(posts.drop("post_content"), "publish", types)
    newest = per_site_limit(published, n, site) if site else published.orderBy(*newest_first()).limit(n)
    return servable_posts(newest, hidden)


def with_content(listed: DataFrame, posts: DataFrame) -> DataFrame:
    """Add ``post_content`` to listed posts; Spark broadcasts the listed rows when they measure small."""
    return listed.join(posts.select("id", "post_content"), "id").select(*listed.columns, "post_content")


def collect_terms(post_terms: DataFrame) -> DataFrame:
    """Sorted term names per post and taxonomy."""
    return post_terms.groupBy("post_id", "taxonomy").agg(
        F.array_sort(F.collect_list("name")).alias("names")
    )


def terms_by_post(post_terms: DataFrame) -> DataFrame:
    """One row per post with its ``categories`` and ``tags`` arrays."""

    def names(taxonomy: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("taxonomy") == taxonomy, F.col("name"))))

    return post_terms.groupBy("post_id").agg(
        names("category").alias("categories"), names("post_tag").alias("tags")
    )


def with_author(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Add ``author`` from ``authors(author_id, display_name)``; unknown authors are ''."""
    names = authors.select(F.col("author_id").alias("post_author"), "display_name")
    joined = posts.join(names, "post_author", "left")
    return joined.withColumn("author", text(F.col("display_name"))).drop("display_name")


def with_terms(posts: DataFrame, post_terms: DataFrame) -> DataFrame:
    """Add term arrays, aggregated before the join so that rows do not multiply."""
    terms = terms_by_post(post_terms).withColumnRenamed("post_id", "id")
    empty = F.array().cast("array<string>")
    return posts.join(terms, "id", "left").withColumns(
        {name: F.coalesce(F.col(name), empty) for name in ("categories", "tags")}
    )


def with_image(posts: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``image`` from ``images(post_id, image)``; posts without one keep null."""
    return posts.join(images.select(F.col("post_id").alias("id"), "image"), "id", "left")
