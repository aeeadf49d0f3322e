"""Web pages: link extraction, page rules, attributes and main text. Everything is a native expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Path segments and file types that lead to no article.
SKIPPED_SEGMENTS = ("members", "login", "logout", "register", "sign-up", "account", "privacy", "cart", "contact", "feed", "rss", "contact-us", "search", "feeds", "faq", "comments", "comment", "about")
SKIPPED_TYPES = ("css", "js", "png", "jpg", "jpeg", "gif", "ico", "svg", "pdf", "zip", "xml", "rss", "php", "mp4", "webp", "avif")


def netloc(url: Column) -> Column:
    """Host and port of an absolute URL in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link on a page: absolute, scheme-relative, rooted, query-only, fragment or relative; ``undotted`` takes dots out."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(root, link)).when(link.startswith("?"), F.concat(path, link))
            .when(link.startswith("#") | (link == ""), F.concat(path, link)).otherwise(F.concat(folder, link)))


def undotted(url: Column) -> Column:
    """``./`` and ``../`` taken out of an absolute URL's path, at any depth; steps above the root stay at the root."""
    head, tail = F.regexp_extract(url, r"^([^/?#]*//[^/?#]*)", 1), F.regexp_extract(url, r"([?#].*)$", 1)
    path = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    steps = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.array().cast("array<string>"), lambda done, s: (
        F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))))
    steps = F.when(path.rlike(r"/\.\.?$"), F.array_append(steps, F.lit(""))).otherwise(steps)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(head, F.lit("/"), F.array_join(steps, "/"), tail)).otherwise(url)


def canonical(url: Column) -> Column:
    """URL without query, fragment and trailing slashes; the slash of a bare host stays."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(bare.rlike(r"^https?://[^/]+/$"), bare).otherwise(F.regexp_replace(bare, r"/+$", ""))


def wanted_link(url: Column, page_caps: dict[str, int] | None = None, more_segments: tuple[str, ...] = ()) -> Column:
    """Whether a link leads to an article: no skipped segment (a site may have more) or file type, no tag, comment or system path, no page beyond its host's cap."""
    low = F.lower(url)
    ok = ~low.rlike("/(?:" + "|".join((*SKIPPED_SEGMENTS, *more_segments)) + ")(?:/|$)") & ~low.rlike(r"\.(?:" + "|".join(SKIPPED_TYPES) + r")(?:\?|$)") & ~low.rlike("/tag/|/wp-|comment")
    for host, cap in (page_caps or {}).items():
        number = F.regexp_extract(low, r"/page/([0-9]+)/", 1).try_cast("bigint")
        ok = ok & ~(low.contains(host) & number.isNotNull() & (number > cap))
    return ok


def links(pages: DataFrame, page_caps: dict[str, int] | None = None) -> DataFrame:
    """(src, dst): distinct canonical links of pages (url, html) to articles of their own host."""
    raw = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href=[\"'](.*?)[\"']"), F.lit(1))).alias("link"))
    link = F.regexp_replace(F.trim(F.col("link")), r"^[\s:;]+", "")
    link = F.regexp_replace(link, r"^(https?):/(?!/)", "$1://")
    raw = raw.select(F.col("url").alias("src"), link.alias("link"))
    full = raw.select("src", resolve(F.col("src"), F.col("link")).alias("dst"))
    full = full.withColumn("dst", undotted(F.col("dst")))
    full = full.where(F.col("dst").startswith("http") & (netloc(F.col("dst")) == netloc(F.col("src"))) & wanted_link(F.col("dst"), page_caps))
    return full.select("src", canonical(F.col("dst")).alias("dst")).distinct()


def file_name(url: Column, limit: int = 80) -> Column:
    """File name of a saved page: scheme dropped, runs of other characters become one underscore, cut at ``limit``."""
    return F.concat(F.substring(F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"[^A-Za-z0-9_-]+", "_"), 1, limit), F.lit(".html"))


def root_page(name: Column, hosts: tuple[str, ...] = (), endings: tuple[str, ...] = ("com",)) -> Column:
    """Whether a saved page's name is that of a site's root: host and ending, perhaps a page number. Without ``hosts`` every host counts."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.html$", ""), r"(?:_\d{0,4}){0,2}_?$", "")
    site = F.regexp_replace(stem, "^www_", "")
    host, ending = F.substring_index(site, "_", 1), F.substring_index(site, "_", -1)
    ok = (site == F.concat_ws("_", host, ending)) & ending.isin(*endings) & host.rlike("^[a-z0-9-]+$")
    return (ok & host.isin(*hosts) if hosts else ok) | (F.lower(name) == "index.html")


def skip_reason(name: Column, size: Column, phrases: tuple[str, ...] | dict[str, tuple[str, ...]] = (), min_size: int = 500, site: Column | None = None, html: Column | None = None,
                markers: dict[str, tuple[str, ...]] | None = None, endings: tuple[str, ...] = ("com",)) -> Column:
    """First rule by which a page is skipped: small, root, phrase, topic; null if it is kept.

    ``phrases`` are for all sites or by ``site``. A site in ``markers`` needs one of its markers in the page's ``html``, in any case.
    """
    low = F.lower(name)
    out = F.when(size < min_size, "small").when(root_page(name, endings=endings), "root")
    for where, words in (phrases.items() if isinstance(phrases, dict) else [(None, phrases)]):
        for p in words:
            out = out.when(low.contains(p) if where is None else (site == where) & low.contains(p), "phrase")
    for where, words in (markers or {}).items():
        body = F.lower(F.coalesce(html, F.lit("")))
        found = F.lit(False)
        for m in words:
            found = found | body.contains(m.lower())
        out = out.when((site == where) & ~found, "topic")
    return out


def is_html(status: Column, content_type: Column) -> Column:
    """Whether a response is a page: status 200 and an HTML content type, whatever its parameters; false where one is missing."""
    return F.coalesce((status == 200) & F.lower(content_type).contains("text/html"), F.lit(False))


def page_type(url: Column) -> Column:
    """What a page is by its address: show, recap or other."""
    return F.when(url.contains("/shows/"), "show").when(url.contains("recap"), "recap").otherwise("other")


def saved_pages(pages: DataFrame, order: str) -> DataFrame:
    """(domain, name, url) of pages (url): folder and file name of each, of equal ones the last by ``order``."""
    x = pages.where("url is not null").select(F.regexp_replace(netloc(F.col("url")), r"^www\.", "").alias("domain"), file_name(F.col("url")).alias("name"), "url", F.col(order).alias("_order"))
    return x.groupBy("domain", "name").agg(F.max_by("url", "_order").alias("url"))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (url) that the rules (host, prefix and, if given, allow) of their host let pass: the longest matching prefix decides, at equal length it is allowed."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    allow = F.col("allow") if "allow" in rules.columns else F.lit(False)
    hosts = rules.groupBy("host").agg(F.collect_set(F.struct(F.length("prefix").alias("n"), allow.alias("allow"), "prefix")).alias("_rules"))
    x = pages.withColumns({"_host": netloc(F.col("url")), "_path": F.when(path == "", "/").otherwise(path)})
    x = x.join(hosts, x._host == hosts.host, "left")
    hit = F.array_max(F.filter("_rules", lambda r: F.col("_path").startswith(r["prefix"])))
    return x.where(F.coalesce(hit["allow"], F.lit(True))).select(*pages.columns)


def _first(col: Column, *patterns: str) -> Column:
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(col, p, 1), r"\s+", " ")), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def _meta(kind: str, name: str) -> tuple[str, str]:
    value = r"content=\"([^\"]*)\""
    key = rf"{kind}=[\"']{name}[\"']"
    return rf"(?is)<meta\b[^>]*{key}[^>]*{value}", rf"(?is)<meta\b[^>]*{value}[^>]*{key}"


def attributes(html: Column) -> dict[str, Column]:
    """Title, author, date, description, url and tags of a page; each by its first alternative that is not blank."""
    url = _first(html, *_meta("property", "og:url"))
    author = _first(html, *_meta("name", "author"), r"(?is)<span[^>]*class=[\"']author[^>]*>\s*<a[^>]*>(.*?)<", r"(?is)\"author\"\s*:\s*\{[^}]*\"name\"\s*:\s*\"([^\"]*)\"")
    date = _first(html, *_meta("property", "article:published_time"), r"(?is)<time[^>]*class=[\"'](?:entry-date\s+)?published[\"'][^>]*datetime=[\"']([^\"']*)[\"']", r"(?is)\"datePublished\"\s*:\s*\"([^\"]*)\"")
    description = _first(html, *_meta("name", "description"), *_meta("property", "description"), *_meta("property", "og:description"))
    banner = F.regexp_extract(html, r"(?is)<section[^>]*class=[\"']banner[^>]*>(.*?)</section>", 1)
    scope = F.when(url.contains("/shows/"), banner).otherwise(html)
    found = F.concat(*[F.regexp_extract_all(scope, F.lit(rf"(?is)<a\b[^>]*{a}[^>]*>(.*?)</a>"), F.lit(1)) for a in (r"class=[\"']post_tags[\"']", r"rel=[\"']tag[\"']")])
    tags = F.array_distinct(F.transform(F.filter(found, lambda t: F.length(F.trim(t)) > 1), lambda t: F.trim(F.regexp_replace(t, r"<[^>]+>", ""))))
    return {"title": _first(html, r"(?is)<title>(.*?)</title>"), "author": author, "date": F.regexp_replace(date, "[\"']", ""), "description": description, "url": url, "tags": tags}


def main_text(html: Column) -> Column:
    """Words of the article region in lower case: article, else content block, else main, else body; scripts, frames, forms and figures go."""
    region = F.lit("")
    for p in (r"(?is)<body\b[^>]*>.*?</body>", r"(?is)<main\b[^>]*>.*?</main>", r"(?is)<div id=\"content\".*?(?=<div class=\"comment)", r"(?is)<article\b[^>]*>.*?</article>"):
        region = F.coalesce(F.nullif(F.regexp_extract(html, p, 0), F.lit("")), region)
    for tag in ("script", "style", "aside", "nav", "form", "figure", "time"):
        region = F.regexp_replace(region, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    region = F.regexp_replace(F.regexp_replace(region, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(region, r"[^a-zA-Z0-9가-힣]", " ")), r"\s+", " "))


def document_text(title: Column, description: Column, main: Column, tags: Column, stop_words: tuple[str, ...]) -> Column:
    """Text of a page for the index: title, description, filtered main text and tags."""
    from lexiloom.functions.normalise import keep_word

    words = F.array_join(F.filter(F.split(main, " "), lambda w: keep_word(w, stop_words)), " ")
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9가-힣]", " ")), r"\s+", " "))
    return F.trim(F.concat_ws(" ", clean(title), clean(description), words, clean(F.array_join(tags, " "))))
