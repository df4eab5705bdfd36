"""Small scalar columns: rounding, labels, times, URLs, JSON shapes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5): how scores are rounded; round() on doubles differs between engines."""
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(whole > 0, half_up(100.0 * part / whole)).otherwise(F.lit(0).cast("long"))


def rate_per_mille(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, half up; null of nothing."""
    return F.when(whole > 0, F.floor(1000.0 * part / whole + 0.5) / 10)


def score_label(score: Column, steps: tuple[tuple[int, str], ...] = ((90, "excellent"), (70, "good"), (60, "pass")), below: str = "fail") -> Column:
    out = F.lit(below)
    for least, label in sorted(steps):
        out = F.when(score >= least, label).otherwise(out)
    return out


def duration(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)


def relative_time(now_ms: Column, then_ms: Column) -> Column:
    """'now', minutes, hours or days ago; the future counts as now."""
    minutes = F.floor(F.greatest(now_ms - then_ms, F.lit(0)) / 60000).cast("long")
    return F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))


def clamped_count(text: Column, most: int = 100) -> Column:
    """A count typed in: digits only, null below 1, at most ``most``."""
    t = F.trim(text)
    n = F.when(F.regexp_like(t, F.lit("^[0-9]+$")), F.coalesce(t.try_cast("long"), F.lit(2**62)))
    return F.when(n >= 1, F.least(n, F.lit(most).cast("long")))


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit("^https?://")), F.lit(False))


def is_iso_date(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.lit(False))


def not_before(date: Column, than: str) -> Column:
    """ISO dates compared as text; a missing one is the oldest."""
    return F.coalesce(date, F.lit("")) >= than


def host(url: Column) -> Column:
    """Lower-case host without scheme and user, and without a port (``host_and_port`` keeps it); null where there is none."""
    part = F.split(F.split(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[/?#]")[0], "@")
    bare = F.regexp_replace(F.lower(F.element_at(part, -1)), ":[0-9]*$", "")
    return F.when(F.contains(url, F.lit("://")) & (bare != ""), bare)


def host_and_port(url: Column) -> Column:
    """The same with a port that isn't the scheme's own (80 for http, 443 for https)."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?[^/?#@]*:([0-9]+)(?:[/?#]|$)", 1)
    usual = F.when(F.lower(url).startswith("https:"), "443").when(F.lower(url).startswith("http:"), "80").otherwise("")
    return F.when((port != "") & (port != usual), F.concat(host(url), F.lit(":"), port)).otherwise(host(url))


def has_primary(urls: Column, primary: tuple[str, ...]) -> Column:
    """Whether any URL of an array<string> is on one of the primary hosts or below it."""
    on = lambda h: F.exists(F.array(*map(F.lit, primary)), lambda p: (h == p) | F.endswith(h, F.concat(F.lit("."), p)))
    return F.exists(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(on(host(u)), F.lit(False))) if primary else F.lit(False)


def host_suffixes(host_: Column) -> Column:
    """array<string>: a.b.c, b.c, c: turns a suffix rule into an equi-join."""
    parts = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def pretty_url(url: Column) -> Column:
    """host, path and the ``id`` parameter, for people."""
    ident = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.when(F.length(path) > 1, path).otherwise(""), F.when(ident != "", F.concat(F.lit(" #"), ident)).otherwise(""))


def source_label(url: Column, sites: dict[str, str], laws: dict[str, dict[str, str]] | None = None, acts: dict[str, str] | None = None, paths: dict[str, list[tuple[str, str]]] | None = None, law: str = "law") -> Column:
    """A short name of a source; the first that fits, each for a host and those below it: laws (host -> code -> name; the parameters ``pcode`` and
    ``flno`` name the code and the article), acts (host -> label; the parameter ``uri`` has a CELEX number, type 3, R, of which year and number are given),
    paths (host -> [(part of the path, label)], the last with an empty part), sites (host -> label). Else the host without ``www.``; what has no host is given as it is."""
    at = F.lower(host(url))
    below = lambda domain: (at == domain) | F.endswith(at, F.lit(f".{domain}"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    value = lambda name: F.nullif(F.try_url_decode(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    cases = []
    for domain, names in (laws or {}).items():
        known = F.coalesce(*(F.when(value("pcode") == code, name) for code, name in names.items()), F.lit(law))
        cases.append((below(domain), F.concat(known, F.coalesce(F.concat(F.lit(" §"), value("flno")), F.lit("")))))
    for domain, label in (acts or {}).items():
        celex = F.coalesce(value("uri"), F.lit(""))
        number = F.regexp_extract(celex, r"3([0-9]{4})R([0-9]+)", 2)
        short = F.when(F.regexp_replace(number, "^0+", "") == "", "0").otherwise(F.regexp_replace(number, "^0+", ""))
        cases.append((below(domain), F.when(number != "", F.concat(F.lit("EU Reg "), F.regexp_extract(celex, r"3([0-9]{4})R([0-9]+)", 1), F.lit("/"), short)).otherwise(F.lit(label))))
    for domain, parts in (paths or {}).items():
        cases.append((below(domain), F.coalesce(*(F.when(F.contains(path, F.lit(part)), label) for part, label in parts))))
    cases += [(below(domain), F.lit(label)) for domain, label in sites.items()]
    out = F.regexp_replace(at, r"^www\.", "")
    for when, label in reversed(cases):
        out = F.when(when, label).otherwise(out)
    return F.when(F.coalesce(at, F.lit("")) == "", url).otherwise(out)


def feedback_url(base: str, ident: Column, stem: Column, most: int = 100) -> Column:
    """Form-encoded; the stem is cut after ``most`` characters and marked so."""
    cut = F.when(F.length(stem) > most, F.concat(F.substring(stem, 1, most), F.lit("…"))).otherwise(stem)
    return F.concat(F.lit(base + "?id="), F.url_encode(ident), F.lit("&stem="), F.url_encode(F.coalesce(cut, F.lit(""))))


def markdown_to_html(text: Column) -> Column:
    """Escaped, then headings, bold, italics, code, list items and line breaks, in that order."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for pattern, by in ((r"(?m)^### (.*)$", "<h3>$1</h3>"), (r"(?m)^## (.*)$", "<h2>$1</h2>"), (r"(?m)^# (.*)$", "<h1>$1</h1>"), (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "<em>$1</em>"), (r"`([^`\n]+)`", "<code>$1</code>"), (r"(?m)^[-*] (.*)$", "<li>$1</li>"), (r"\n", "<br>")):
        out = F.regexp_replace(out, pattern, by)
    return out


#: What makes a key private, wherever it stands in the key's name, in any case.
PRIVATE = ("password", "passwd", "token", "auth", "secret", "api[_-]?key", "credential", "session", "cookie", "email", "phone", "ssn", "身分證", "身份證", "credit[_-]?card")


def redacted(context: Column, private: tuple[str, ...] = PRIVATE) -> Column:
    """map<string,string> with the values of private keys hidden."""
    return F.transform_values(context, lambda k, v: F.when(F.regexp_like(k, F.lit(f"(?i){'|'.join(private)}")), F.lit("[redacted]")).otherwise(v))


def redacted_json(text: Column, private: tuple[str, ...] = PRIVATE, depth: int = 4) -> Column:
    """The same for JSON of any nesting: values of private keys hidden at every level, what lies deeper than ``depth`` cut off. Null
    for what is no JSON. Arrow, as Spark has no function over JSON of unknown shape."""
    import json
    import re

    hides = re.compile("|".join(private), re.IGNORECASE)

    def clean(x, level):
        if level > depth:
            return "[truncated]"
        if isinstance(x, dict):
            return {k: "[redacted]" if hides.search(k) else clean(v, level + 1) for k, v in x.items()}
        return [clean(v, level + 1) for v in x] if isinstance(x, list) else x

    def one(t):
        try:
            return json.dumps(clean(json.loads(t), 0), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return apply(text)


def reply_text(json: Column) -> Column:
    """The text of a model's reply in whichever shape it came; a plain string counts as itself, in a list too."""
    paths = ("$.message.content[0].text", "$.message.content[0]", "$.message.content", "$.content[0].text", "$.content[0]", "$.text", "$.content", "$.response")
    texts = [F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths]
    # An object or a list isn't a text.
    found = F.coalesce(*(F.when(~F.regexp_like(t, F.lit(r"^[{\[]")), t) for t in texts))
    return F.coalesce(found, F.when(~F.regexp_like(F.trim(json), F.lit(r"^[{\[]")), F.regexp_replace(json, '^"|"$', "")))


def level_rank(level: Column, order: tuple[str, ...] = ("debug", "info", "warn", "error")) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.lower(level))


def authority(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with host and tier ('primary', 'secondary' or null: unknown, never assumed). rules (host, tier): a rule fits its host
    and all below it; primary wins. An equi-join on the suffixes of distinct hosts; the optimizer broadcasts by measured size."""
    hosts = urls.select(host(F.col(url)).alias("host")).where(F.col("host").isNotNull()).distinct()
    ranked = rules.select(F.col("host").alias("_suffix"), F.when(F.col("tier") == "primary", 0).when(F.col("tier") == "secondary", 1).alias("_rank"))
    tiers = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("_suffix")).join(ranked, "_suffix").groupBy("host").agg(F.min("_rank").alias("_rank"))
    out = urls.withColumn("host", host(F.col(url))).join(tiers, "host", "left")
    return out.withColumn("tier", F.when(F.col("_rank") == 0, "primary").when(F.col("_rank") == 1, "secondary")).drop("_rank").select(*[c for c in urls.columns if c not in ("host", "tier")], "host", "tier")
