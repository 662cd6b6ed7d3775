"""Text functions as column expressions; where Catalyst has no primitive, as pure Python wrapped in Arrow UDFs.

White space means what Python's str.split() means: Unicode blanks and \\x1c-\\x1f too.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java's (?U)\s lacks the four separators that Python counts as blanks.
SPACE = r"(?U)[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """The blank-delimited tokens; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), f"{SPACE}+"), lambda w: w != "")


def count_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def split_sentences(text: Column | str) -> Column:
    """Sentences end at . ! or ? before a blank. Blank texts have none."""
    parts = F.split(stripped(F.coalesce(_col(text), F.lit(""))), rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def sanitize_content(text: Column | str) -> Column:
    """Line and paragraph separators become line feeds."""
    return F.translate(_col(text), "\u2028\u2029", "\n\n")


#: Bidirectional controls, which a label may not hold.
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"


def sanitize_label(text: Column | str, limit: int = 512) -> Column:
    """A one-line label: bidirectional and control characters but tabs, and line separators, go; blanks collapse; cut to limit and stripped. See nfc for composition."""
    c = F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"[{BIDI}\u2028\u2029\x00-\x08\x0a-\x1f\x7f-\x9f]", "")
    return F.regexp_replace(F.substring(stripped(F.regexp_replace(c, f"{SPACE}+", " ")), 1, limit), f"{SPACE}+$", "")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which Catalyst lacks."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def source_label(path: Column | str) -> Column:
    """The last part of a path, with either slash."""
    return F.element_at(F.split(_col(path), r"[/\\]"), -1)


def page_slug(seed: Column | str, index: Column | str) -> Column:
    """First 12 digits of the seed's MD5, and the index in four digits or more."""
    return F.format_string("%s-%04d", F.substring(F.md5(_col(seed)), 1, 12), _col(index).cast("int"))


def is_metric_probe(line: Column | str, least: int = 30) -> Column:
    """One token, and nothing else, at least thirty times."""
    w = words(line)
    return (F.size(w) >= least) & (F.size(F.array_distinct(w)) == 1)


_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def array_run(least: int = 64) -> str:
    """Pattern of a run of at least that many comma-separated numbers."""
    return rf"{_NUMBER}(?:\s*,\s*{_NUMBER}){{{least - 1},}}"


def long_arrays(text: Column | str, least: int = 64) -> Column:
    """Number of values of each numeric run that truncation would shorten."""
    runs = F.regexp_extract_all(_col(text), F.lit(f"({array_run(least)})"), F.lit(1))
    return F.transform(runs, lambda r: F.size(F.split(r, ",")))


def code_fence(body: Column | str, language: str = "") -> Column:
    """The body in a fence longer than any run of backticks in it."""
    c = _col(body)
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))
    return F.concat(fence, F.lit(f"{language}\n"), F.regexp_replace(c, r"\n+$", ""), F.lit("\n"), fence)


def fenced_document(body: Column | str, language: str, url: Column | str, content_type: Column | str) -> Column:
    """A fenced body under a front matter of its URL and content type (without parameters)."""
    kind = F.trim(F.split(F.coalesce(_col(content_type), F.lit("")), ";")[0])
    head = F.concat(F.lit("---\nurl: "), _col(url), F.lit("\ncontent_type: "), F.when(kind == "", F.lit("''")).otherwise(kind), F.lit("\n---\n\n"))
    return F.concat(head, code_fence(body, language), F.lit("\n"))


def flow_quality(html: Column | str) -> Column:
    """The coarse score: 1.0 for a page of more than 500 characters, else 0.5."""
    return F.when(F.length(F.coalesce(_col(html), F.lit(""))) > 500, F.lit(1.0)).otherwise(F.lit(0.5))


def normalize_markdown(text: Column | str) -> Column:
    """Line feeds alone end lines, other controls are blanks, blank lines do not pile up."""
    c = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", " "), r"\n{3,}", "\n\n")
    return F.concat(stripped(c), F.lit("\n"))


def strip_line_ends(text: Column | str) -> Column:
    """Lines lose their trailing blanks, but for those that end with the two that mean a break."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.when(x.endswith("  "), x).otherwise(F.regexp_replace(x, f"{SPACE}+$", "")))
    return F.array_join(lines, "\n")


def clean_cell(cell: Column | str, limit: int = 500) -> Column:
    """A table cell on one line: line ends and controls are blanks, bars escaped, cut with an ellipsis."""
    c = F.regexp_replace(F.coalesce(_col(cell).cast("string"), F.lit("")), r"[\r\n\x00-\x08\x0b-\x1f\x7f]", " ")
    c = stripped(F.replace(c, F.lit("|"), F.lit("\\|")))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def canonical_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def fingerprint(value: Column) -> Column:
    """SHA-256 of a struct's JSON; give the fields in name order for the hash to be canonical."""
    return F.sha2(canonical_json(value), 256)


def truncated_middle(text: Column | str, cap: int = 8000, head: float = 0.6) -> Column:
    """Long messages lose their middle; a marker says how many characters the text has over the cap, and counts toward it."""
    c = _col(text)
    marker = F.concat(F.lit("\n\n... ["), (F.length(c) - cap).cast("string"), F.lit(" characters omitted] ...\n\n"))
    room = F.lit(cap) - F.length(marker)
    first = F.floor(room * head).cast("int")
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(F.substring(c, F.lit(1), first), marker, F.right(c, room - first)))


def capped(value: Column | str, limit: int = 2000) -> Column:
    """Long values are cut and marked."""
    c = _col(value)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def title_slug(title: Column | str, limit: int = 50, default: str = "capture") -> Column:
    """Letters, digits, blanks, - and _ of a title, at most limit of them; the default where there is no title."""
    kept = F.substring(stripped(F.regexp_replace(_col(title), r"(?U)[^\p{Alnum} _-]", "")), 1, limit)
    return F.when(F.coalesce(_col(title), F.lit("")) == "", F.lit(default)).otherwise(kept)


def member_name(index: Column | str, url: Column | str, output: str = "markdown", suffix: str = ".md") -> Column:
    """Name of a bundle's member: its place from 1 in three digits, the URL without scheme as a slug of at most 80 characters, and the output."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(_col(url), F.lit("")), "https?://", ""), "[^A-Za-z0-9._-]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 80)
    return F.format_string(f"%03d_%s_{output}{suffix}", (_col(index) + 1).cast("int"), s)


def overage_marker(project: Column | str, at: Column | str) -> Column:
    return F.concat_ws(":", F.lit("overage"), _col(project).cast("string"), F.date_format(_col(at), "yyyyMMddHHmmss"))


def overage_time(marker: Column | str) -> Column:
    """Time of a marker; null where it is none."""
    return F.try_to_timestamp(F.regexp_extract(_col(marker), r"^overage:[^:]+:(\d{14})$", 1), F.lit("yyyyMMddHHmmss"))


def human_bytes(n: Column | str) -> Column:
    c, out = _col(n).cast("double"), None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        hit = F.concat(F.format_string("%.1f", c / 1024**power), F.lit(f" {unit}"))
        out = F.when(c >= 1024**power, hit) if out is None else out.when(c >= 1024**power, hit)
    return out.otherwise(F.concat(c.cast("long").cast("string"), F.lit(" B")))


def host_name(url: Column | str) -> Column:
    """First label of a URL's host, without www., for a file's name."""
    host = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)
    label = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")[0]
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("output")).otherwise(label)


def object_key(name: Column | str) -> Column:
    """A safe object name from a path (non-ASCII must have been folded, see ascii_fold)."""
    c = F.replace(F.element_at(F.split(_col(name), "/"), -1), F.lit(".."), F.lit(""))
    c = F.replace(F.regexp_replace(c, r"[<>:\"|?*\x00-\x1f\x7f]", ""), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(c, F.lit("")).isin("", "."), F.lit("output.bin")).otherwise(c)


def object_path(env: str, project: Column | str, endpoint: str, name: Column | str) -> Column:
    """Where an object is kept: environment, files, project, endpoint (its route's last part, slashes as dashes), name."""
    where = endpoint.replace("/v1/convert/", "").replace("/", "-")
    return F.concat(F.lit(f"{env}/files/"), _col(project).cast("string"), F.lit(f"/{where}/"), object_key(name))


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII kept."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def signature(secret: str, stamp: int, body: bytes) -> str:
    """HMAC-SHA-256 of 'stamp.body'."""
    return hmac.new(secret.encode(), f"{stamp}.".encode() + body, sha256).hexdigest()


def signature_holds(secret: str, stamp: int, body: bytes, given: str, now: int, skew: int = 300) -> bool:
    """Right, and not older or newer than skew seconds."""
    return abs(now - stamp) <= skew and hmac.compare_digest(signature(secret, stamp, body), given)


def signed(secret: str):
    """Column function (stamp, body) -> signature, as webhooks carry it."""

    @F.pandas_udf(T.StringType())
    def run(stamp: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([signature(secret, int(t), b.encode()) for t, b in zip(stamp, body, strict=True)])

    return run


def render_quality(html: Column | str, least: int = 20) -> Column:
    """0.3 for a page of fewer visible words, else 1.0."""
    return F.when(visible_words(html) < least, F.lit(0.3)).otherwise(F.lit(1.0))


def visible_text(html: Column | str) -> Column:
    """Text without scripts, styles, comments and tags, by patterns; entities stay as they are."""
    c = F.coalesce(_col(html), F.lit(""))
    for tag in ("script", "style", "noscript", "template"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "), f"{SPACE}+", " "))


def visible_words(html: Column | str) -> Column:
    return count_words(visible_text(html))


def decode_bytes(raw: bytes) -> str:
    """UTF-8 (a mark dropped), else Windows-1252, else Latin-1 with its C1 places read as Windows-1252 where that has one."""
    for charset in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue

    def place(b: int) -> str:
        try:
            return bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(b)

    return "".join(map(place, raw))


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def content_category(content_type: Column | str) -> Column:
    """json, text or null (HTML and all else) from a content type."""
    kind = F.lower(F.trim(F.split(F.coalesce(_col(content_type), F.lit("")), ";")[0]))
    return F.when((kind == "application/json") | kind.endswith("+json"), F.lit("json")).when(kind == "text/plain", F.lit("text"))


def charset(content_type: Column | str) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(_col(content_type), F.lit("")), r"(?i)charset\s*=\s*\"?([A-Za-z0-9._-]+)", 1))
    return F.when(found == "", F.lit("utf-8")).otherwise(found)


PUA = re.compile("[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd]")
