"""Scalar functions as column expressions: paths, ids, dates, HTML, tags, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_to_text(html: Column, most: int | None = None) -> Column:
    """Text of a page: scripts, styles and tags go, white space runs become one space; entities stay."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]+>", " "), r"\s+", " "))
    return body if most is None else F.substring(body, 1, most)


def truncated(text: Column, most: int) -> Column:
    return F.length(text) > most


def doc_id(prefix: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(prefix), F.lit(":"), key).cast("binary"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug_of(url: Column) -> Column:
    """The last segment of a path, without the query."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/")), "/"), -1)


def video_id(url: Column) -> Column:
    """The 11 characters after v=, /v/, youtu.be/ or embed/; null without."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|/v/|youtu\.be/|embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def relative_path(path: Column, root: Column) -> Column:
    """Below ``root`` by whole components; other paths as they are."""
    base = F.rtrim(root, F.lit("/"))
    return F.when((F.length(base) > 0) & F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2)).otherwise(path)


def project_of_dashed(name: Column) -> Column:
    """The project in a dash-joined home path: what follows ``projects``, by slashes; else the last part."""
    parts = F.filter(F.split(name, "-"), lambda x: x != "")
    at = F.array_position(parts, "projects").cast("int")
    after = F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0)))
    return F.when((at > 0) & (at < F.size(parts)), F.concat_ws("/", after)).otherwise(F.coalesce(F.element_at(parts, -1), name))


def directory_key(path: Column) -> Column:
    """The first two directories of a path, else the first, else ``(root)``."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"))).when(F.size(parts) == 2, F.concat(parts[0], F.lit("/"))).otherwise(F.lit("(root)"))


def clock_seconds(stamp: Column) -> Column:
    """Seconds of ``H:MM:SS``, ``M:SS`` or ``HH:MM:SS.mmm``."""
    return F.aggregate(F.transform(F.split(stamp, ":"), lambda x: x.try_cast("double")), F.lit(0.0), lambda s, x: s * 60 + x)


def clock_text(seconds: Column) -> Column:
    """``H:MM:SS`` from an hour on, else ``M:SS``."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def compact_date(day: Column) -> Column:
    """``yyyymmdd`` with dashes; anything else unchanged."""
    return F.when(F.length(day) == 8, F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(day)


def any_timestamp(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """The first format that fits the whole or the start of the text; null if none does."""
    sizes = {"yyyy-MM-dd'T'HH:mm:ss": 19, "yyyy-MM-dd": 10}
    return F.coalesce(*[F.try_to_timestamp(F.substring(text, 1, sizes.get(f, 40)), F.lit(f)) for f in formats])


def product_status(featured_at: Column, daily_rank: Column) -> Column:
    return F.when(F.coalesce(featured_at, F.lit("")) != "", "featured").when(daily_rank > 0, "launched").otherwise("created")


def topic_tags(topics: Column, created: Column, most: int = 4) -> Column:
    """The first topics of a comma list in lower case with dashes, then the month."""
    t = F.slice(F.filter(F.split(topics, ", "), lambda x: x != ""), 1, most)
    month = F.when(F.length(created) >= 7, F.substring(created, 1, 7))
    return F.concat_ws(",", F.transform(t, lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("-"))), month)


def name_parts(username: Column) -> Column:
    """Alphabetic parts of at least 3 letters, lower-case, split at ``_ - .``; else at capitals."""
    parts = F.filter(F.split(username, r"[_\-.]"), lambda x: F.rlike(x, F.lit(r"^\p{L}{3,}$")))
    camel = F.filter(F.regexp_extract_all(username, F.lit(r"(\p{Lu}?\p{Ll}+)"), 1), lambda x: F.length(x) >= 3)
    return F.transform(F.when(F.size(parts) >= 2, parts).otherwise(F.when(F.size(camel) >= 2, camel).otherwise(parts)), lambda x: F.lower(x))


def profile_matches(username: Column, url: Column, title: Column) -> Column:
    """Whether a search result is that person's profile: its slug holds the name or the name it (of 4 letters), or two parts of the name occur."""
    slug = F.lower(F.regexp_extract(url, r"linkedin\.com/in/([^/?#]+)", 1))
    plain = F.regexp_replace(slug, "[^a-z0-9]", "")
    user = F.regexp_replace(F.lower(username), "[^a-z0-9]", "")
    near = (F.length(plain) >= 4) & (F.length(user) >= 4) & (F.contains(plain, user) | F.contains(user, plain))
    hits = F.size(F.filter(name_parts(username), lambda p: F.contains(F.lower(title), p) | F.contains(slug, p)))
    return (slug != "") & (near | (hits >= 2))


def mermaid_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_]", "_")


def mermaid_label(text: Column) -> Column:
    return F.translate(text, '"', "'")


def sibling_context(previous: Column, own: Column, following: Column, most: int = 1000) -> Column:
    """The texts that are there, by lines, if there are several; cut at ``most``."""
    parts = F.filter(F.array(previous, own, following), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 1, F.substring(F.concat_ws("\n", parts), 1, most))


def looks_binary(text: Column) -> Column:
    """A NUL anywhere, or more than 20 control characters among the first 2000."""
    head = F.regexp_replace(F.substring(text, 1, 2000), r"[^\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.contains(text, F.lit("\0")) | (F.length(head) > 20)
