"""Credentials out of texts: ordered rules, then tokens of high entropy; each match gives way to its rule's name and four hex digits of its hash."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import entropy

# A word's bounds in ASCII: a word character stands inside them, whatever the class of the token's last characters.
_B, _E = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", "(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
# Rules in order (name, the part before the secret, the secret), the address format, the sweep's token and threshold.
RULES = [
    ("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws_key", "", rf"{_B}AKIA[0-9A-Z]{{16}}{_E}"),
    ("github_token", "", rf"{_B}gh[pousr]_[A-Za-z0-9]{{36,}}{_E}"),
    ("api_key", "", rf"(?i){_B}sk-[A-Za-z0-9_-]{{20,}}{_E}"),
    ("jwt", "", rf"{_B}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{_E}"),
    ("bearer_header", r"(?i)^authorization:\s*bearer\s+", r'(?i)authorization:\s*bearer\s+[^\s"\\]+'),
]
URI = "artifact://sha256/[0-9a-f]{64}"
TOKEN = rf"{_B}[A-Za-z0-9+/_-]{{32,}}(?:={{1,2}}(?=[A-Za-z0-9_])|{_E})"
BITS = 4.0
REPORT = [
    ("personal path", r"(/home/[A-Za-z0-9_.-]+|/media/[A-Za-z0-9_.-]+|/Users/[A-Za-z0-9_.-]+|[A-Za-z]:[\\/]+Users[\\/]+[A-Za-z0-9_.-]+)"),
    ("GitHub token", r"(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})"),
    ("API key", r"(sk-(proj-)?[A-Za-z0-9_-]{24,}|AKIA[A-Z0-9]{16})"),
    ("private key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("private network address", r"(^|\W)(10(\.\d{1,3}){3}|192\.168(\.\d{1,3}){2}|172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2})(\W|$)"),
    ("hardware address", r"(^|\W)([A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2}(\W|$)"),
    ("personal email", rf"(?:{_B}|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))[A-Za-z0-9._%+-]+@(?!(?:users\.noreply\.github\.com|example\.(?:com|org|net|invalid))(?![A-Za-z0-9_]))[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?![A-Za-z0-9_])"),
]
EMAIL = REPORT[-1]
#: Literals of which every match of a pattern holds one: a clean text costs searches for them.
HELD = {
    "personal path": ["/home/", "/media/", "Users"], "GitHub token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"], "API key": ["sk-", "AKIA"], "private key": ["-----BEGIN "],
    "private network address": ["10.", "192.168.", "172."], "hardware address": [":"], "personal email": ["@"],
}


def marker(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"[REDACTED:{name}:"), F.substring(F.sha2(value, 256), 1, 4), F.lit("]"))


def replace_each(text: Column, pattern: str, new) -> Column:
    """Every match of a pattern by new(match)."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(F.zip_with(between, matches, lambda b, m: F.when(m.isNull(), b).otherwise(F.concat(b, new(m)))), "")).otherwise(text)


def _then(text: Column, step) -> Column:
    """step(text), with text computed once however often the step reads it."""
    return F.element_at(F.transform(F.array(text), step), 1)


def _may(text: Column, name: str) -> Column:
    """Whether a text can hold a match of the rule, by its literal part: a clean text costs a search for it."""
    held = {"private_key": "-----BEGIN ", "aws_key": "AKIA", "jwt": "eyJ"}
    if name in held:
        return F.contains(text, F.lit(held[name]))
    if name == "github_token":
        return F.contains(text, F.lit("gh")) & text.rlike("gh[pousr]_")
    return F.contains(F.lower(text), F.lit("sk-" if name == "api_key" else "authorization:"))


def _new(name: str, before: str, m: Column) -> Column:
    return F.concat(F.regexp_extract(m, before, 0), marker(name, F.regexp_replace(m, before, ""))) if before else marker(name, m)


def _swept(m: Column) -> Column:
    return ~m.startswith("artifact://") & (entropy(m) >= BITS)


SWEEP = rf"{URI}(?![A-Za-z0-9+/_=-])|{TOKEN}"


def _ruled(name: str, before: str, pattern: str):
    return lambda t: F.when(_may(t, name), replace_each(t, pattern, lambda m: _new(name, before, m))).otherwise(t)


def _put(name: str, before: str):
    return lambda x, m: F.when(m.isNull(), x).otherwise(F.concat(x, _new(name, before, m)))


def redact(text: Column) -> Column:
    out = text
    for rule in RULES:
        out = _then(out, _ruled(*rule))
    return _then(out, lambda t: replace_each(t, SWEEP, lambda m: F.when(_swept(m), marker("high_entropy", m)).otherwise(m)))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, the redacted text, how many matches gave way, and how many of each rule."""
    out = docs.select("doc_id", F.col("text").alias("t0"))
    for i, (name, before, pattern) in enumerate(RULES):
        t, may = F.col(f"t{i}"), F.coalesce(_may(F.col(f"t{i}"), name), F.lit(False))
        out = out.withColumn(f"m{i}", F.when(may, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")))
        found = F.col(f"m{i}")
        out = out.withColumn(f"t{i + 1}", F.when(F.size(found) > 0, F.array_join(F.zip_with(F.split(t, pattern, -1), found, _put(name, before)), "")).otherwise(t))
    last = F.col(f"t{len(RULES)}")
    out = out.withColumn("tokens", F.transform(F.coalesce(F.regexp_extract_all(last, F.lit(SWEEP), 0), F.array().cast("array<string>")), lambda m: F.struct(m.alias("m"), _swept(m).alias("hit"))))
    put = F.array_join(F.zip_with(F.split(last, SWEEP, -1), "tokens", lambda x, m: F.when(m.isNull(), x).otherwise(F.concat(x, F.when(m["hit"], marker("high_entropy", m["m"])).otherwise(m["m"])))), "")
    counts = [(name, F.size(f"m{i}")) for i, (name, _, _) in enumerate(RULES)] + [("high_entropy", F.size(F.filter("tokens", lambda m: m["hit"])))]
    total = sum((n for _, n in counts), F.lit(0)).cast("long")
    return out.select("doc_id", F.when(F.size("tokens") > 0, put).otherwise(last).alias("text"), total.alias("hits"), F.struct(*[n.cast("long").alias(k) for k, n in counts]).alias("by_rule"))


def hits_by_rule(docs: DataFrame) -> DataFrame:
    """Matches of each rule over all texts, of the rules that have any."""
    found = redacted(docs).select("by_rule")
    names = [*[name for name, _, _ in RULES], "high_entropy"]
    per = found.agg(*[F.coalesce(F.sum(f"by_rule.{n}"), F.lit(0)).alias(n) for n in names])
    return per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in names])).alias("x")).select("x.*").filter("hits > 0")


def redacted_bytes(blobs: DataFrame) -> DataFrame:
    """Contents (doc_id, body) redacted where they are text; others are unchanged."""
    text = blobs.filter(F.is_valid_utf8(F.col("body").cast("string")))
    done = redacted(text.select("doc_id", F.col("body").cast("string").alias("text")))
    return done.select("doc_id", F.col("text").cast("binary").alias("body"), (F.col("hits") > 0).alias("redacted")).unionByName(blobs.filter(~F.is_valid_utf8(F.col("body").cast("string"))).select("doc_id", "body", F.lit(False).alias("redacted")))


def committer_allowed(name: Column, email: Column, committer: bool) -> Column:
    """Whether a commit's identity may be published: a user's no-reply address, or, as committer, the server's own."""
    return F.endswith(email, F.lit("@users.noreply.github.com")) | (F.lit(committer) & (name == "GitHub") & (email == "noreply" + "@github.com"))


def publication_report(docs: DataFrame) -> DataFrame:
    """doc_id and rule for each pattern that a text must not hold."""
    may = lambda n: reduce(or_, [F.contains("text", F.lit(x)) for x in HELD[n]])
    named = F.array_compact(F.array(*[F.when(may(n), F.when(F.col("text").rlike(p), n)) for n, p in REPORT]))
    return docs.select("doc_id", F.explode(named).alias("rule"))


def unpublishable(files: DataFrame, roots: list[str], allowed: list[str]) -> DataFrame:
    """Files (path) that hold local data or settings by their path: below a private root or the fixtures, settings of an environment, data and archive formats. Those that `allowed` names may be of a format that needs leave (.json, .tgz)."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"(?<=[^.])(\.[^.]+)$", 1)
    local = F.element_at(parts, 1).isin(roots) | F.startswith("path", F.lit("tests/fixtures/")) | F.exists(parts, lambda p: F.startswith(p, F.lit(".env"))) | suffix.isin(".zip", ".jsonl", ".csv", ".sse", ".log", ".txt", ".bundle")
    return files.filter(local | (suffix.isin(".json", ".tgz") & ~F.col("path").isin(allowed))).select("path")
