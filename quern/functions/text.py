"""Text, URL, number and date functions as column expressions. IDs of the survey in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import TRACKING


def clean_text(x: Column) -> Column:
    """White space, Unicode's included, collapsed and stripped [S3, S24]."""
    return F.btrim(F.regexp_replace(x, "(?U)\\s+", " "))


def strip_html(x: Column) -> Column:
    """Tags become spaces; the ends are stripped [S4]."""
    return F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "(?U)^\\s+|\\s+$", "")


def truncate(x: Column, n: int) -> Column:
    """Up to n characters, cut back to a space, with an ellipsis [S5]."""
    return F.when(F.length(x) > n, F.concat(F.regexp_replace(F.substring(x, 1, n - 1), " [^ ]*$", ""), F.lit("…"))).otherwise(x)


def first_sentences(x: Column, n: int) -> Column:
    """The first n sentences, joined by one space [S6]; nothing is stripped, so white space at an end is a part."""
    return F.array_join(F.slice(F.split(x, "(?U)(?<=[.!?])\\s+"), 1, n), " ")


def canonical_url(url: Column) -> Column:
    """Lower-cased host, no fragment, tracking keys or blank values, repeated keys together [S1].

    Keys keep the order of their first appearance; a path loses trailing slashes, an
    empty one is a slash. All of it is array functions over the split query.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?]*)?", 0)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.regexp_replace(rest, "^[^?]*\\??", "")
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.regexp_extract(p, "^[^=]*", 0).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING))
    # ``let``: the kept pairs are evaluated once, then read for the order of keys and for each key's values.
    joined = F.transform(
        F.array(kept),
        lambda ps: F.array_join(
            F.flatten(
                F.transform(
                    F.array_distinct(F.transform(ps, lambda p: p["k"])),
                    lambda k: F.transform(F.filter(ps, lambda p: p["k"] == k), lambda p: F.concat(_recoded(p["k"]), F.lit("="), _recoded(p["v"]))),
                )
            ),
            "&",
        ),
    )[0]
    return F.concat(F.lower(head), F.when(path == "", F.lit("/")).otherwise(path), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def _recoded(x: Column) -> Column:
    """Decoded and encoded again, as form fields; tilde stays, the asterisk doesn't."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def story_id(source: Column, url: Column) -> Column:
    """Source and 12 hex digits of SHA-256 over source and canonical URL [S2]."""
    return F.concat(source, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", source, url), 256), 1, 12))


def safe_float(x: Column) -> Column:
    """Digits and dots only; what isn't a number then is null [S13]."""
    return F.regexp_replace(x, "[^0-9.]", "").try_cast("double")


def parse_date(x: Column) -> Column:
    """The first of three formats that fits, else null [S8]."""
    t = F.btrim(x)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in ("M/d/yyyy", "M/d/yy", "MMMM d, yyyy")]
    return F.coalesce(*tries).cast("date")


def parse_timestamp(x: Column) -> Column:
    """ISO 8601, else an RFC 2822 date without its weekday, else null [A4]."""
    rfc = F.regexp_replace(F.regexp_replace(F.btrim(x), "^[A-Za-z]{3},\\s*", ""), "\\b(GMT|UT|UTC|Z)$", "+0000")
    return F.coalesce(x.try_cast("timestamp"), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))


def summary_of_mail(body: Column, snippet: Column, most: int = 200) -> Column:
    """Whole sentences of the body, else the snippet, up to a length [S20].

    A fold over sentences with the state (joined, length without spaces, done).
    """
    text = F.when(F.coalesce(body, F.lit("")) != "", body).otherwise(F.coalesce(snippet, F.lit("")))
    text = F.btrim(F.regexp_replace(F.regexp_replace(text, "https?://\\S+", ""), "\\s+", " "))
    sentences = F.filter(F.split(F.substring(text, 1, 1500), "(?<=[.!?])\\s+"), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        more = (acc["t"] == "") | ((acc["n"] + F.length(s) <= most) & ~acc["done"])
        go = more & ~acc["done"]
        return F.struct(
            F.when(go, F.when(acc["t"] == "", s).otherwise(F.concat(acc["t"], F.lit(" "), s))).otherwise(acc["t"]).alias("t"),
            F.when(go, acc["n"] + F.length(s)).otherwise(acc["n"]).alias("n"),
            (acc["done"] | ~more).alias("done"),
        )

    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.btrim(F.substring(F.aggregate(sentences, start, step)["t"], 1, most))


def summary_of_story(title: Column, snippet: Column, content: Column) -> Column:
    """Title, dash, two sentences of the snippet or else the content [S19]."""
    body = F.coalesce(F.nullif(snippet, F.lit("")), F.nullif(content, F.lit("")))
    return F.concat_ws(" — ", title, first_sentences(body, 2))


def escape_html(x: Column) -> Column:
    """Escaped text with line breaks [S22]."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def absolute_url(x: Column, host: str) -> Column:
    """Prefixed with the host unless it begins with http [S25]."""
    return F.when(x.startswith("http"), x).otherwise(F.concat(F.lit(host), x))


def first_number(x: Column) -> Column:
    """The first integer, commas allowed, else 0 [S27]."""
    return F.coalesce(F.replace(F.regexp_extract(x, "([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def goal(html: Column, label: str) -> Column:
    """Of bold labels that are just ``label goal``, the last one's percentage [S14].

    It is the first percentage anywhere in what follows the label: the text up to the
    next tag, or, where a tag follows at once, that element with all it holds.
    """
    bold = F.lit(r"(?is)<strong\b[^>]*>((?:(?!</strong).)*)</strong\s*>(?=([^<]+|<([a-z][a-z0-9]*)\b[^>]*>.*?</\3\s*>|<[^>]*>|))")
    pairs = F.arrays_zip(F.regexp_extract_all(html, bold, F.lit(1)).alias("label"), F.regexp_extract_all(html, bold, F.lit(2)).alias("after"))
    name = lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "(?U)^\\s+|\\s+$", ""), ":+$", ""))
    ours = F.filter(pairs, lambda p: name(p["label"]) == f"{label} goal")
    found = F.filter(F.transform(ours, lambda p: F.regexp_extract(p["after"], "([0-9.]+)\\s*%", 1)), lambda x: x != "")
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def decoded_base64url(x: Column) -> Column:
    """UTF-8 text of base64url data, padded or not, with U+FFFD for what isn't UTF-8; null if it isn't base64 [A17]."""
    plain = F.regexp_replace(F.translate(x, "-_", "+/"), "[=\\s]", "")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")
    raw = F.when(F.length(plain) % 4 != 1, F.try_to_binary(padded, F.lit("base64")))
    return F.make_valid_utf8(raw.cast("string"))


def rendered_html(x: Column) -> Column:
    """The text of a mail's HTML, block elements on lines of their own [A17]; what has no tag stays as it is."""
    out = F.regexp_replace(x, "(?is)<(style|script)\\b[^>]*>.*?</\\1\\s*>", "")
    block = "<(?:div|p|tr|li)(?:\\s[^>]*)?>"
    out = F.regexp_replace(out, "(?i)<br\\b[^>]*>|</(?:div|p|tr)\\s*>", "\n")
    out = F.regexp_replace(out, f"(?i)(?!{block})<[^>]*>", "")
    # A block begins a line, unless one begins there already.
    out = F.regexp_replace(F.regexp_replace(out, f"(?i)(?<=[^\\n])(?:{block})+", "\n"), f"(?i){block}", "")
    for a, b in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    text = F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "(?U)^\\s+|\\s+$", "")
    return F.when(F.contains(x, F.lit("<")) & F.contains(x, F.lit(">")), text).otherwise(x)


def age_of_story(at: Column, as_of: Column) -> Column:
    """Minutes below an hour, hours below a day, else days; floors, so the future is negative."""
    s = as_of.cast("double") - at.cast("double")
    n = lambda d: F.floor(s / d).cast("string")
    return F.when(at.isNull(), "unknown").when(s < 3600, F.concat(n(60), F.lit("m ago"))).when(s < 86400, F.concat(n(3600), F.lit("h ago"))).otherwise(F.concat(n(86400), F.lit("d ago")))


def age_of_mail(at: Column, as_of: Column) -> Column:
    """As on stories, but truncating, and with words for no time at all."""
    m = ((as_of.cast("double") - at.cast("double")) / 60).cast("long")
    n = lambda d: F.floor(m / d).cast("string")
    return F.when(at.isNull(), "unknown time").when(m < 1, "just now").when(m < 60, F.concat(n(1), F.lit("m ago"))).when(m < 1440, F.concat(n(60), F.lit("h ago"))).otherwise(F.concat(n(1440), F.lit("d ago")))
