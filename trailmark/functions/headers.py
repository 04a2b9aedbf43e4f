"""Document headers and the article metadata block as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import json_quote, text


def _escape_quotes(col: Column) -> Column:
    return F.replace(col, F.lit('"'), F.lit('\\"'))


def yaml_header(
    title: Column,
    url: Column,
    author: Column,
    date: Column,
    categories: Column,
    tags: Column,
    excerpt: Column,
) -> Column:
    """Front matter and title; the excerpt line appears only when there is one."""
    names = [F.array_join(F.coalesce(a, F.array().cast("array<string>")), ", ") for a in (categories, tags)]
    excerpt_line = F.when(
        text(excerpt) != "", F.concat(F.lit('excerpt: "'), _escape_quotes(excerpt), F.lit('"\n'))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('---\ntitle: "'), _escape_quotes(text(title)),
        F.lit('"\nurl: '), text(url),
        F.lit("\nauthor: "), text(author),
        F.lit("\ndate: "), text(date),
        F.lit("\ncategories: ["), names[0],
        F.lit("]\ntags: ["), names[1],
        F.lit("]\n"), excerpt_line,
        F.lit("---\n\n# "), text(title), F.lit("\n\n"),
    )


def quote_header(title: Column, url: Column, author: Column, date: Column) -> Column:
    return F.concat(
        F.lit("# "), text(title),
        F.lit("\n\n> Source: "), text(url),
        F.lit("  \n> Author: "), text(author),
        F.lit("  \n> Date: "), text(date), F.lit("\n\n"),
    )


def article_struct(
    title: Column,
    url: Column,
    published: Column,
    modified: Column,
    author: Column,
    site_name: Column,
    site_url: Column,
    image: Column,
) -> Column:
    """Article metadata in fixed key order; a null image leaves its key out of the JSON."""

    def typed(kind: str, **members: Column) -> list[Column]:
        return [F.lit(kind).alias("@type"), *[text(c).alias(k) for k, c in members.items()]]

    return F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Article").alias("@type"),
        text(title).alias("headline"),
        text(url).alias("url"),
        text(published).alias("datePublished"),
        text(modified).alias("dateModified"),
        F.struct(*typed("Person", name=author)).alias("author"),
        F.struct(*typed("Organization", name=site_name, url=site_url)).alias("publisher"),
        F.nullif(image, F.lit("")).alias("image"),
    )


def article_json(article: Column) -> Column:
    """The article struct as compact JSON."""
    return F.to_json(article)


def article_block(article: Column) -> Column:
    """The article struct as a fenced JSON block, indented by four blanks a level."""

    def line(indent: int, key: str, value: Column) -> Column:
        return F.concat(F.lit(" " * indent + f'"{key}": '), json_quote(value))

    def nested(key: str, *names: str) -> Column:
        inner = [line(8, name, article[key][name]) for name in names]
        return F.concat(F.lit(f'    "{key}": {{\n'), F.concat_ws(",\n", *inner), F.lit("\n    }"))

    flat = [
        line(4, key, article[key])
        for key in ("@context", "@type", "headline", "url", "datePublished", "dateModified")
    ]
    image = F.when(article["image"].isNotNull(), line(4, "image", article["image"]))
    members = F.concat_ws(
        ",\n", *flat, nested("author", "@type", "name"), nested("publisher", "@type", "name", "url"), image
    )
    return F.concat(F.lit("```json\n{\n"), members, F.lit("\n}\n```\n"))
