"""Lines of messages that must outlive a condensed session: extraction, dedup, budget, rendering, and labels of work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import lines, token_estimate

# Kinds and the patterns of their lines, the file pattern, the kinds by protection and by place in the rendering.
PATTERNS = [
    ("errors", r"(^|\W)ERR_[A-Z0-9_]+(\W|$)"),
    ("errors", r"(?i)(^|\W)exit code [1-9][0-9]*(\W|$)"),
    ("errors", r"(^|\W)error\[[A-Z]?\d+\]"),
    ("errors", r"(^|\W)Traceback \(most recent call last\)"),
    ("errors", r"(^|\W)[A-Z][A-Za-z]*(Error|Exception): "),
    ("errors", r"(^|\W)error: "),
    ("tests", r"^\s*FAIL(ED)?\s+\S"),
    ("tests", r"(^|\W)test result: "),
    ("tests", r"(^|\W)\d+ (passed|failed)([,;] .*)?$"),
    ("tests", r"(^|\W)FAILED(\W|$)"),
    ("commands", r"^\s*\$\s+.+$"),
    ("user_pins", r"(^|\W)(MUST NOT|MUST|SHALL NOT|SHOULD NOT|DO NOT|DON'T|NEVER|ALWAYS|REQUIRED)(\W|$)"),
    ("user_pins", r"(?i)^(please\s+)?(must not|must|do not|don't|never|always|avoid)(\W|$)"),
    ("user_pins", r"(務必|必須|必需|不可|不得|禁止|切勿|请勿|請勿)"),
    ("user_pins", r"(?i)^(MUST:|CONSTRAINT:|約束:|Correction:|Latest correction:|更正:|修正:)"),
    ("deliverables", r"(?i)^ {0,3}([-*+]\s+|#{1,6}\s+)?(Q\d+|Question\s?\d+|Task\s?\d+)\s*[:.)]"),
]
FILE = r"""(^|[\s"'`(])([\w.-]+/)+[\w.-]+\.[A-Za-z0-9]{1,8}(:\d+)?"""
PROTECTED = ["deliverables", "user_pins", "errors", "tests", "files", "artifacts", "commands"]
RENDERED = ["deliverables", "files", "artifacts", "commands", "tests", "errors", "user_pins"]
LABEL = r"(?i)(^|\W)(Q\d+|Question\s?\d+|Task\s?\d+)(\W|$)"
RANGE = r"(?i)Q(\d+)\s*-\s*Q?(\d+)"
# The same as whole words, and what ends an entry's subject behind its first label or range.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
WORD_LABEL = rf"{_B}(Q\d+|Question\s?\d+|Task\s?\d+){_E}"
WORD_RANGE = rf"{_B}Q(\d+)\s*-\s*Q?(\d+){_E}"
DELIMITER = r"(?:[:.—]|\s-\s)"
SPAN = 50
OVERHEAD = 4


def line_anchors(messages: DataFrame) -> DataFrame:
    """session, seq, line_no, kind, text: one row for each kind that a line belongs to. Pins come from users' lines that ask nothing."""
    kinds = list(dict.fromkeys(k for k, _ in PATTERNS))
    asks = F.col("line").rlike(r"[?？]\s*$")

    def held(kind: str) -> Column:
        found = F.lit(False)
        for k, p in PATTERNS:
            if k == kind:
                found = found | (F.regexp_replace("line", r"^\s+|\s+$", "") if kind == "user_pins" else F.col("line")).rlike(p)
        return F.when(found & ((F.col("role") == "user") & ~asks if kind == "user_pins" else F.lit(True)), kind)

    rows = messages.select("session", "seq", "role", F.posexplode(lines(F.col("text"))).alias("i", "line"))
    tagged = rows.withColumn("kind", F.explode(F.array_compact(F.array(*map(held, kinds)))))
    return tagged.select("session", "seq", (F.col("i") + 1).cast("long").alias("line_no"), "kind", F.regexp_replace("line", r"^\s+|\s+$", "").alias("text"))


def file_anchors(messages: DataFrame) -> DataFrame:
    """session, seq, line_no, kind, text for paths with at least one slash and an extension, with the line where one is named."""
    rows = messages.select("session", "seq", F.posexplode(lines(F.col("text"))).alias("i", "line")).filter(F.contains("line", F.lit("/")))
    found = rows.withColumn("m", F.explode(F.regexp_extract_all("line", F.lit(FILE), 0)))
    return found.select("session", "seq", (F.col("i") + 1).cast("long").alias("line_no"), F.lit("files").alias("kind"), F.regexp_replace("m", r"""^[\s"'`(]""", "").alias("text"))


def anchors(messages: DataFrame) -> DataFrame:
    return line_anchors(messages).unionByName(file_anchors(messages))


def distinct_anchors(found: DataFrame) -> DataFrame:
    """One row for each kind and text of a session, at its first place; a pin at its last; a work item at each of its messages."""
    own = F.when(F.col("kind") == "deliverables", F.col("seq")).otherwise(-1)
    seq = F.when(F.col("kind") == "user_pins", F.max("seq")).otherwise(F.min("seq"))
    return found.withColumn("own", own).groupBy("session", "kind", "text", "own").agg(seq.alias("seq"), F.count("*").alias("seen")).drop("own")


def _rank(order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col("kind"))


def budgeted(distinct: DataFrame, budget: int) -> DataFrame:
    """The anchors that fit a session's budget, most protected and then latest first; one that is too large is passed over and smaller ones may follow.

    A session's distinct anchors are gathered in one row, as the choice depends on all before it.
    """
    cost = token_estimate(F.col("text")) + OVERHEAD
    rows = distinct.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(_rank(PROTECTED).alias("r"), (-F.col("seq")).alias("s"), "text", cost.alias("cost"), "kind"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("kept"))
    step = lambda a, x: F.when(
        a.used + x.cost <= budget, F.struct((a.used + x.cost).alias("used"), (a.n + 1).alias("n"), F.concat(a.kept, F.array(F.concat(x.kind, F.lit(": "), x.text))).alias("kept"))
    ).otherwise(a)
    out = rows.select("session", F.size("all").cast("long").alias("found"), F.aggregate("all", start, step).alias("o"))
    return out.select("session", "found", F.col("o.used").alias("used"), F.col("o.n").alias("n_kept"), F.array_join("o.kept", "\n").alias("kept"))


def missing(distinct: DataFrame, messages: DataFrame) -> DataFrame:
    """Anchors that the last message of their session doesn't hold word for word."""
    last = messages.groupBy("session").agg(F.max_by("text", "seq").alias("answer"))
    return distinct.join(last, "session").filter(~F.contains("answer", F.col("text"))).select("session", "kind", "text", "seq")


def rendered(distinct: DataFrame) -> DataFrame:
    """A session's anchors as one list, by kind and place."""
    rows = distinct.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(_rank(RENDERED).alias("r"), "seq", "text", "kind"))).alias("all"))
    return rows.select("session", F.array_join(F.transform("all", lambda x: F.concat(F.lit("- "), x.kind, F.lit(": "), x.text)), "\n").alias("body"))


def normal_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"\s+", ""), "^question", "q")


def labels(messages: DataFrame) -> DataFrame:
    """The first label of each message that has one."""
    found = messages.select("session", "seq", F.regexp_extract("text", LABEL, 2).alias("label")).filter("label <> ''")
    return found.select("session", "seq", normal_label(F.col("label")).alias("label"))


def label_ranges(messages: DataFrame, column: str = "subject") -> DataFrame:
    """One row for each label of an entry's subject, which goes from its first label to the next delimiter: those it names, and those within its ranges such as Q1-Q3.

    A range that spans more than SPAN, or doesn't end above its start, names its two ends only. A closing bracket is a delimiter right behind the first label or range.
    """
    rest = messages.select("session", "seq", F.regexp_extract(column, f"(?is){WORD_LABEL}.*", 0).alias("rest"))
    split = rest.withColumn("head", F.regexp_extract("rest", f"(?i)^(?:{WORD_RANGE}|{WORD_LABEL})", 0)).withColumn("tail", F.substring(F.col("rest"), F.length("head") + 1, F.length("rest")))
    tail = F.when(F.rlike("tail", F.lit(r"^\s*\)")), "").otherwise(F.regexp_replace("tail", f"(?s){DELIMITER}.*", ""))
    rows = split.select("session", "seq", F.concat("head", tail).alias("subject"))
    ends = lambda i: F.regexp_extract_all("subject", F.lit(f"(?i){WORD_RANGE}"), i)
    spans = F.transform(F.arrays_zip(ends(1).alias("a"), ends(2).alias("b")), lambda x: F.struct(x.a.try_cast("long").alias("a"), x.b.try_cast("long").alias("b")))
    some = F.filter(spans, lambda x: (x.b > x.a) & (x.b - x.a <= SPAN))
    within = F.flatten(F.transform(some, lambda x: F.transform(F.sequence(x.a, x.b), lambda i: F.concat(F.lit("q"), i.cast("string")))))
    named = F.transform(F.regexp_extract_all("subject", F.lit(f"(?i){WORD_LABEL}"), 1), normal_label)
    return rows.select("session", "seq", F.explode(F.array_distinct(F.concat(named, within))).alias("label"))


def unresolved(found: DataFrame, tracked: DataFrame) -> DataFrame:
    """Labels at their first place that are not tracked, or that a session holds more than once."""
    items = found.filter("kind = 'deliverables'").withColumn("label", normal_label(F.regexp_extract("text", LABEL, 2)))
    known = tracked.select("session", "label").distinct().withColumn("known", F.lit(True))
    per = items.groupBy("session", "label").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return per.join(known, ["session", "label"], "left").filter("known is null or n > 1").select("session", "label", "n", "seq")


def leading_labels(texts: DataFrame, column: str = "text") -> DataFrame:
    """The labels that open a sentence, clause or line of each text, each once."""
    found = F.transform(F.regexp_extract_all(column, F.lit(rf"(?i)(?:\A|[.!?:\n]+)[\s*.)\d-]*(Q\d+|Question\s?\d+|Task\s?\d+)(?![A-Za-z0-9_])"), 1), normal_label)
    return texts.select("session", "seq", F.explode(F.array_distinct(found)).alias("label"))


def pending(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether the answer to each item (session, seq, label, marked, after) may still be outstanding, by the session's last answer (session, last_answer).

    A marked item is outstanding until an answer after its barrier; any other if it is no older than the last answer. -1 is an unknown place.
    """
    last = F.col("last_answer")
    marked = F.col("after").isNull() | (F.col("after") < 0) | last.isNull() | (last <= F.col("after"))
    other = (F.col("seq") != -1) & last.isNotNull() & (F.col("seq") >= last)
    return items.join(answers.select("session", "last_answer"), "session", "left").select("session", "seq", "label", F.when(F.col("marked"), marked).otherwise(F.coalesce(other, F.lit(False))).alias("pending"))


def open_items(items: DataFrame, tracked: DataFrame) -> DataFrame:
    """Labels (session, seq, label, pending) at their first place that are pending, held twice, or not among those tracked (session, label)."""
    known = tracked.select("session", "label").distinct().withColumn("known", F.lit(True))
    per = items.groupBy("session", "label").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pending")).alias("first"))
    return per.join(known, ["session", "label"], "left").filter("known is null or n > 1 or first.pending").select("session", "label", F.col("first.seq").alias("seq"))


# The notes on items that a checkpoint, or a narrative, leaves out.
UNRECONCILED = ": not reflected in completed or open by this checkpoint's own classification — verify whether it still needs an answer (machine-checked, see Anchors)"
UNMENTIONED = ": not mentioned anywhere in this summary — verify whether it still needs an answer (machine-checked, see Anchors)"


def notes(found: DataFrame, text: str, pointer: Column | None = None) -> DataFrame:
    """A note on each open item (session, label, seq), with the address of its full text where there is one."""
    where = F.lit("") if pointer is None else F.when(pointer.isNull(), "").otherwise(F.concat(F.lit(" — full text: "), pointer))
    return found.select("session", "seq", F.concat(F.col("label"), F.lit(text), where).alias("note"))


def reconciled(found: DataFrame, opened: DataFrame) -> DataFrame:
    """Notes on the open items that their session's list of open work (session, label) doesn't name."""
    return notes(found.join(opened.select("session", "label").distinct(), ["session", "label"], "left_anti"), UNRECONCILED)


def retained_chronology(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """The last answer within each session's replaced span, and the later of it and the last one behind the span. answers: session, pos, seq, delivered."""
    rows = answers.join(spans.select("session", "start", "end"), "session").filter("delivered")
    inside = F.max(F.when(F.col("pos").between(F.col("start"), F.col("end")), F.col("seq")))
    return rows.groupBy("session").agg(inside.alias("inside"), F.greatest(inside, F.max(F.when(F.col("pos") > F.col("end"), F.col("seq")))).alias("last_answer"))


def by_kind(distinct: DataFrame) -> DataFrame:
    """How many anchors of each kind a session holds, and the first place of one."""
    return distinct.groupBy("session", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def verbatim(found: DataFrame, messages: DataFrame) -> DataFrame:
    """The anchors that stand word for word in the message that they are said to come from."""
    return found.join(messages.select("session", "seq", F.col("text").alias("body")), ["session", "seq"]).filter(F.contains("body", F.col("text"))).select("session", "seq", "kind", "text")


def cited(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Addresses that messages cite: anchors where a claim in `refs` holds the content, else invented."""
    rows = messages.select("session", "seq", F.explode(F.regexp_extract_all("text", F.lit("artifact://sha256/([0-9a-f]{64})"), 1)).alias("sha256"))
    known = refs.select("sha256").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "sha256", "left").select("session", "seq", F.concat(F.lit("artifact://sha256/"), F.col("sha256")).alias("text"), F.coalesce("known", F.lit(False)).alias("resolved"))
