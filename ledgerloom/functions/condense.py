"""Plain functions on one session's messages: exact extraction of anchors with quotas and budget, their rendering, and summary documents.

Extraction is a fold whose every step depends on all before it (a match that a full quota turns away may come again later), so it has no
declarative form; operators apply these functions to one session a call.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from ledgerloom.sources.log import HEADING

# Patterns over whole texts, kinds from the least protected, labels of rendered lines, kinds in rendered order.
LABEL = r"(?:Q\d+|Question\s?\d+|Task\s?\d+)"
LINES = {
    "errors": [re.compile(p, f) for p, f in [(r"^.*\bERR_[A-Z0-9_]+\b.*$", re.M), (r"^.*\bexit code [1-9][0-9]*\b.*$", re.M | re.I), (r"^.*\berror\[[A-Z]?\d+\].*$", re.M), (r"^.*\bTraceback \(most recent call last\).*$", re.M), (r"^.*\b[A-Z][A-Za-z]*(?:Error|Exception): .*$", re.M), (r"^.*\berror: .*$", re.M)]],
    "tests": [re.compile(p, re.M) for p in (r"^\s*FAIL(?:ED)?\s+\S.*$", r"^.*\btest result: .*$", r"^.*\b\d+ (?:passed|failed)(?:[,;] .*)?$", r"^.*\bFAILED\b.*$")],
    "commands": [re.compile(r"^\s*\$\s+(.+)$", re.M)],
}
FILE = re.compile(r"""(?:^|[\s"'`(])((?:[\w.-]+/)+[\w.-]+\.[A-Za-z0-9]{1,8})(?::(\d+))?""", re.M | re.A)
ADDRESS = re.compile(r"artifact://sha256/[0-9a-f]{64}")
PROTECTION = ["commands", "artifacts", "files", "tests", "errors", "user_pins", "deliverables"]
SHOWN = {"errors": "error", "tests": "test", "files": "file", "artifacts": "artifact", "commands": "command", "user_pins": "constraint", "deliverables": "deliverable"}
ORDER = ["deliverables", "files", "artifacts", "commands", "tests", "errors", "user_pins"]
MARKERS = ("must:", "constraint:", "約束:", "correction:", "latest correction:", "更正:", "修正:")
EMPHATIC = re.compile(r"\b(?:MUST NOT|MUST|SHALL NOT|SHOULD NOT|DO NOT|DON'T|NEVER|ALWAYS|REQUIRED)\b", re.A)
IMPERATIVE = re.compile(r"^(?:please\s+)?(?:must not|must|do not|don't|never|always|avoid)\b", re.I | re.A)
CJK = re.compile("務必|必須|必需|不可|不得|禁止|切勿|请勿|請勿")
FENCE = re.compile(r"^( {0,3})((?:[-*+]|\d+[.)])\s+)?(?:(`{3,})[^`]*|(~{3,}).*)$")
FENCE_END = re.compile(r"^( *)(`{3,}|~{3,})\s*$")
ITEM = re.compile(rf"^( {{0,3}}(?:[-*+]\s+|#{{1,6}}\s+)?)({LABEL}\s*[:.)])", re.I)
NUMBERED = re.compile(r"^\s*\d+[.)]\s")
CARRIED = re.compile(r"^- ([a-z_]+): (.+)$")
KIND_OF = {v: k for k, v in SHOWN.items()} | {"deliverable_ref": "deliverables", "deliverable_pending": "deliverables", "deliverable_ref_pending": "deliverables"}
COST = 4


@dataclass(frozen=True)
class Anchor:
    kind: str
    text: str
    seq: int
    order: int = 0
    pointer: str | None = None
    stub: bool = False
    pending: bool = False
    after: int | None = None
    carried: bool = False


@dataclass(frozen=True)
class Message:
    """A message's place, its text, and what it is."""

    seq: int
    text: str
    human: bool = False
    checkpoint: bool = False
    delivered: bool = False


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\\\|\\n", lambda m: "\n" if m[0] == "\\n" else "\\", text)


def one_line(text: str) -> str:
    return re.sub(r"\s*\n\s*", " ", text)


def is_pin(line: str) -> bool:
    """Whether a trimmed line is a constraint and no question."""
    if not line or line[-1] in "?？":
        return False
    return line.lower().startswith(MARKERS) or bool(EMPHATIC.search(line) or IMPERATIVE.search(line) or CJK.search(line))


def _fences(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """Each line, and whether it belongs to a fenced block, its fences included."""
    mark, reach = "", 0
    for line in lines:
        if mark:
            yield line, True
            end = FENCE_END.match(line)
            if end and len(end[1]) <= reach and end[2].startswith(mark):
                mark = ""
            continue
        begin = FENCE.match(line)
        if begin:
            mark = begin[3] or begin[4]
            reach = 3 if begin[2] is None else len(begin[1]) + len(begin[2]) + 3
        yield line, begin is not None


def _introduces_list(held: list[str]) -> bool:
    """Whether a numbered line goes on with an item: the nearest line that ends in a colon, is numbered, or opens a paragraph decides."""
    i = len(held) - 1
    while i > 0:
        line = held[i]
        if line.strip() and (line.rstrip().endswith(":") or NUMBERED.match(line) or (not held[i - 1].strip() and not line[:1].isspace())):
            break
        i -= 1
    return held[i].rstrip().endswith(":") or bool(NUMBERED.match(held[i]))


def deliverables(text: str) -> list[str]:
    """The work items of a text, each from its label to the next item's, or to a numbered line that nothing in it introduces; labels within fences count for nothing, items of a label only are none."""
    groups: list[list[str] | None] = []
    for line, fenced in _fences(text.split("\n")):
        item = None if fenced else ITEM.match(line)
        if item:
            groups.append([line[len(item[1]) :]])
        elif not groups or groups[-1] is None:
            continue
        elif not fenced and NUMBERED.match(line) and not _introduces_list(groups[-1]):
            groups.append(None)
        else:
            groups[-1].append(line)
    whole = ["\n".join(g) for g in groups if g]
    return [x.rstrip() for x in whole if re.sub(rf"^{LABEL}\s*[:.)]", "", x, flags=re.I).strip()]


def carried(text: str, seq: int) -> list[Anchor] | None:
    """The anchors that a checkpoint hands on, or null where it has no such block. Each gets a place of its own below zero."""
    at = re.search(rf"^{re.escape(HEADING)}", text, re.M)
    if not at:
        return None
    out: list[Anchor] = []
    for line in text[at.start() :].split("\n")[1:]:
        if line.startswith("## "):
            break
        m = CARRIED.match(line.strip())
        kind = KIND_OF.get(m[1]) if m else None
        if not kind:
            continue
        body = unescaped(m[2]) if kind == "deliverables" else m[2]
        stub, waits = m[1].startswith("deliverable_ref"), m[1].endswith("_pending")
        pointer = ADDRESS.search(body) if stub else None
        out.append(Anchor(kind, body, -(seq * 100_000 + len(out) + 1), 0, pointer[0] if pointer else None, stub, waits, seq if waits else None, True))
    return out


def _matches(m: Message, known) -> Iterator[tuple[str, str, str | None]]:
    """kind, text and the quota that an accepted one counts for, in order. A kind's texts come once a message."""
    for kind, patterns in LINES.items():
        for pattern in patterns:
            for x in pattern.finditer(m.text):
                if x[0].strip():
                    yield kind, x[0].strip(), kind
    for x in FILE.finditer(m.text):
        yield "files", x[1] if x[2] is None else f"{x[1]}:{x[2]}", "files"
    for x in ADDRESS.findall(m.text):
        yield ("artifacts" if known is None or x in known else "invented"), x, None
    if m.human:
        for line in m.text.split("\n"):
            if is_pin(line.strip()):
                yield "user_pins", line.strip(), None
        for item in deliverables(m.text):
            yield "deliverables", item, None


@dataclass
class Found:
    kept: list[Anchor]
    overflow: list[Anchor]
    invented: int
    last_answer: int | None


def cost(a: Anchor) -> int:
    return -(-len(escaped(a.text) if a.kind == "deliverables" else a.text) // 4) + COST


def extract(messages: list[Message], budget: int, quota: int = 24, longest: int = 320, known: set[str] | None = None) -> Found:
    """The anchors of a span: distinct, at most `quota` of a kind and message, none longer than `longest` (pins and items go to the overflow instead), standing in their message, and within the budget.

    known: the addresses that can be read; null: all.
    """
    ledger: dict[tuple, tuple[Anchor, bool]] = {}  # (kind, text, place of an item) -> anchor, whether it is too long; a repeated pin moves to its end
    sources: dict[int, str] = {}
    loose: list[str] = []
    order = invented = 0
    last = None

    def add(a: Anchor, key: tuple, whole: bool = False) -> bool:
        nonlocal order
        long = not whole and len(a.text) > longest
        if long and a.kind not in ("deliverables", "user_pins"):
            return False
        if key in ledger:
            if a.kind != "user_pins":
                return False
            del ledger[key]
        ledger[key] = replace(a, order=order), long
        order += 1
        return True

    for n, m in enumerate(messages):
        if m.seq == -1:
            loose.append(m.text)
        else:
            sources[m.seq] = m.text
        if m.delivered:
            last = m.seq if last is None else max(last, m.seq)
        before = carried(m.text, m.seq) if m.checkpoint and m.text else None
        if before is not None:
            for a in before:
                add(a, (a.kind, a.text, a.seq if a.kind == "deliverables" else None), a.stub)
            continue
        used: dict[str, int] = {}
        for kind, text, counts in _matches(m, known):
            if kind == "invented":
                invented += 1
                continue
            if counts and used.get(counts, 0) >= quota:
                continue
            place = None if kind != "deliverables" else (f"unknown {n}" if m.seq == -1 else m.seq)
            if add(Anchor(kind, text, m.seq), (kind, text, place)) and counts:
                used[counts] = used.get(counts, 0) + 1
    handed = {(a.kind, a.text) for a, _ in ledger.values() if a.carried}
    stands = lambda a: (a.kind, a.text) in handed or (any(a.text in s for s in loose) if a.seq == -1 else a.text in sources.get(a.seq, ""))
    sound = [(a, long) for a, long in ledger.values() if stands(a)]
    ranked = sorted((a for a, long in sound if not long), key=lambda a: PROTECTION.index(a.kind))
    kept, overflow, spent = [], [], 0
    for a in reversed(ranked):
        if spent + cost(a) <= budget:
            spent += cost(a)
            kept.insert(0, a)
        else:
            overflow.append(a)
    return Found(kept, overflow + [a for a, long in sound if long], invented, last)


def is_pending(a: Anchor, last: int | None) -> bool:
    if a.pending:
        return a.after is None or a.after < 0 or last is None or last <= a.after
    return a.seq != -1 and last is not None and a.seq >= last


def label_of(text: str) -> str | None:
    m = re.search(rf"\b({LABEL})\b", text, re.I | re.A)
    return m[1] if m else None


def shown(a: Anchor) -> str:
    return escaped(a.text) if a.kind == "deliverables" else one_line(a.text)


def render(found: Found, uri: str | None = None) -> str:
    """A session's anchors as lines, by kind; items that overflow leave a stub. Without an address for the overflow, items and pins in it are shown whole."""
    kept, over = list(found.kept), list(found.overflow)
    if uri is None:
        back = [a for a in over if (a.kind == "deliverables" and not a.stub) or a.kind == "user_pins"]
        if back:
            kept = sorted(kept + back, key=lambda a: a.order)
            over = [a for a in over if a not in back]
    out = []
    for kind in ORDER:
        for a in (a for a in kept if a.kind == kind):
            name = "deliverable_ref" if kind == "deliverables" and (a.pointer or a.stub) else SHOWN[kind]
            out.append(f"- {name}{'_pending' if kind == 'deliverables' and is_pending(a, found.last_answer) else ''}: {shown(a)}")
    for a in over:
        label = label_of(a.text) if a.kind == "deliverables" else None
        if label:
            where = a.pointer or (None if a.stub else uri)
            out.append(f"- deliverable_ref{'_pending' if is_pending(a, found.last_answer) else ''}: {label}" + (f" (full text: {where})" if where else ""))
    if over:
        out.append(f"- overflow: {len(over)} more anchors " + (f"→ {uri}" if uri else "omitted (not stored)"))
    return "\n".join(out)


def render_overflow(found: Found) -> str:
    return "\n".join(f"{SHOWN[a.kind]}: {shown(a)}" for a in found.overflow)


# Summary documents.
TOP = ("decisions", "files", "tests", "errors", "critical_facts", "user_constraints", "next_step", "artifact_refs")
FLAT = ("schema_version", "goal", "completed", "open", "state", "constraints", "next_step")
PREAMBLE = (
    "This is an automatically generated checkpoint condensing an earlier span of the conversation to free up context. Treat the captured context as established background "
    "and build on it without restating it. Continue the task directly from the messages that follow, without acknowledging this checkpoint."
)


class Refused(ValueError):
    """A text that holds no such document."""


def json_text(raw: str) -> str:
    """The first fenced block, else the first object whose braces balance outside strings."""
    fenced = re.search(r"```(?:json)?\s*\n([\s\S]*?)\n```", raw)
    if fenced:
        return fenced[1]
    depth, quoted, start = 0, False, raw.find("{")
    for m in re.finditer(r'\\.|["{}]', raw[max(start, 0) :], re.S):
        if m[0] == '"':
            quoted = not quoted
        elif not quoted and m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return raw[start : start + m.end()] if start >= 0 else ""
    raise Refused("no object")


def _list(value, name: str) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise Refused(f"{name} is no list")
    return value


def _strings(value, name: str) -> list[str]:
    return [x for x in _list(value, name) if isinstance(x, str)]


def _leaf(owner, key: str, default: str | None = "") -> str | None:
    value = owner.get(key) if isinstance(owner, dict) else None
    return value if isinstance(value, str) else default


def parse(raw: str, version: int = 1) -> dict:
    """A summary document: its structure must hold, leaves of another type take their defaults."""
    try:
        doc = json.loads(json_text(raw))
    except json.JSONDecodeError as e:
        raise Refused("no JSON") from e
    if not isinstance(doc, dict):
        raise Refused("no object")
    if doc.get("schema_version") != version or isinstance(doc.get("schema_version"), bool):
        raise Refused("version")
    task = doc.get("task_state")
    if not isinstance(task, dict):
        raise Refused("no task_state")
    each = lambda name: _list(doc.get(name), name)
    return {
        "schema_version": version, "task_state": {"goal": _leaf(task, "goal"), **{k: _strings(task.get(k), k) for k in ("current_plan", "completed", "open")}},
        "decisions": [{"decision": _leaf(x, "decision"), "reason": _leaf(x, "reason")} for x in each("decisions")],
        "files": [{"path": _leaf(x, "path"), "operation": _leaf(x, "operation", "touched"), "artifact": _leaf(x, "artifact", None)} for x in each("files")],
        "tests": [{"command": _leaf(x, "command"), "status": _leaf(x, "status", "unknown"), "failing": _strings(x["failing"], "failing") if isinstance(x, dict) and "failing" in x else None, "artifact": _leaf(x, "artifact", None)} for x in each("tests")],
        "errors": [{"code": _leaf(x, "code", None), "message": _leaf(x, "message"), "resolved": isinstance(x, dict) and x.get("resolved") is True, "artifact": _leaf(x, "artifact", None)} for x in each("errors")],
        "critical_facts": _strings(doc.get("critical_facts"), "critical_facts"), "user_constraints": _strings(doc.get("user_constraints"), "user_constraints"), "next_step": _leaf(doc, "next_step"),
        "artifact_refs": _strings(doc.get("artifact_refs"), "artifact_refs"),
    }


def parse_flat(raw: str, version: int = 1) -> dict:
    """A flat document, closed and strict, in the shape of the other."""
    text = raw.strip()
    if text.startswith("```"):
        text = re.sub(r"\n```\s*$", "", re.sub(r"^```(?:json)?\s*\n", "", text))
    try:
        flat = json.loads(text)
    except json.JSONDecodeError as e:
        raise Refused("no JSON") from e
    lists = ("completed", "open", "state", "constraints")
    if not isinstance(flat, dict) or flat.get("schema_version") != version or not set(flat) <= set(FLAT):
        raise Refused("object, version or field")
    if not all(isinstance(flat.get(k), str) for k in ("goal", "next_step")) or not all(isinstance(flat.get(k), list) and all(isinstance(x, str) for x in flat[k]) for k in lists):
        raise Refused("type")
    if not flat["goal"].strip() and not flat["next_step"].strip() and not any(flat[k] for k in lists):
        raise Refused("empty")
    return parse(json.dumps({"schema_version": version, "task_state": {"goal": flat["goal"], "completed": flat["completed"], "open": flat["open"]}, "critical_facts": flat["state"], "user_constraints": flat["constraints"], "next_step": flat["next_step"]}), version)


def repair(raw: str, version: int = 1) -> tuple[str, list[str]]:
    """The document with its outermost brace closed, keys that slid into task_state moved up, and single strings made lists; and what was done. Whatever else is wrong leaves the text as it is."""
    text = re.sub(r"\n```\s*$", "", re.sub(r"^```(?:json)?\s*\n", "", raw.strip()))
    done: list[str] = []
    try:
        doc = json.loads(text)
    except json.JSONDecodeError:
        if not (text.startswith("{") and text.endswith("}")):
            return raw, []
        try:  # one brace more makes it whole only if nothing else is missing
            doc, done = json.loads(text + "}"), ["closed-outer-object"]
        except json.JSONDecodeError:
            return raw, []
    task = doc.get("task_state") if isinstance(doc, dict) else None
    if not isinstance(task, dict) or doc.get("schema_version") != version:
        return raw, []
    for key in (k for k in TOP if k in task):
        if key in doc and json.dumps(doc[key]) != json.dumps(task[key]):
            return raw, []
        doc[key] = task.pop(key)
        done.append(f"promoted-{key}")
    tests = [x for x in doc["tests"] if isinstance(x, dict)] if isinstance(doc.get("tests"), list) else []
    for owner, key in [*((task, k) for k in ("current_plan", "completed", "open")), *((doc, k) for k in ("critical_facts", "user_constraints", "artifact_refs")), *((x, "failing") for x in tests)]:
        if isinstance(owner.get(key), str):
            owner[key] = [owner[key]]
            done.append(f"wrapped-{key}")
    return (json.dumps(doc, ensure_ascii=False, separators=(",", ":")), done) if done else (raw, [])


def has_content(doc: dict) -> bool:
    """Whether a document says anything beside its defaults."""

    def said(value, default: str = "") -> bool:
        if isinstance(value, str):
            return value.strip() not in ("", default)
        if isinstance(value, dict):
            return any(said(v, {"operation": "touched", "status": "unknown"}.get(k, "")) for k, v in value.items() if k not in ("resolved", "schema_version"))
        return isinstance(value, list) and any(map(said, value))

    return said(doc)


def ground(doc: dict, outputs: list[str]) -> dict:
    """The document without the file quotes that no tool output holds word for word."""
    sure = lambda x: x["artifact"] is None or any(x["artifact"] in t for t in outputs)
    return doc | {"files": [x if sure(x) else x | {"artifact": None} for x in doc["files"]]}


def subject_labels(entry: str) -> list[str]:
    """Normal labels that an entry's subject names, ranges of up to 50 spelled out."""
    first = re.search(rf"\b({LABEL})\b", entry, re.I | re.A)
    if not first:
        return []
    rest = entry[first.start() :]
    span = re.match(r"Q\d+\s*-\s*Q?\d+\b", rest, re.I | re.A)
    head = span.end() if span else len(first[0])
    ends = [m.start() + (len(m[0]) - 1 if m[0].endswith(")") else 0) for m in [re.compile(r"\s*\)").match(rest, head)] if m] + [m.start() for m in [re.compile(r"[:.—]|\s-\s").search(rest, span.end() if span else 0)] if m]
    subject = rest[: min(ends)] if ends else rest
    out = [normal(x) for x in re.findall(rf"\b({LABEL})\b", subject, re.I | re.A)]
    for a, b in re.findall(r"\bQ(\d+)\s*-\s*Q?(\d+)\b", subject, re.I | re.A):
        if 0 < int(b) - int(a) <= 50:
            out += [f"q{i}" for i in range(int(a), int(b) + 1)]
    return list(dict.fromkeys(out))


def normal(label: str) -> str:
    return re.sub("^question", "q", re.sub(r"\s+", "", label.lower()))


def unresolved(found: Found, tracked: set[str]) -> list[tuple[str, Anchor]]:
    """The label and first anchor of each item that is not tracked, pending, or held twice."""
    per: dict[str, list[tuple[str, Anchor]]] = {}
    for a in (*found.kept, *found.overflow):
        label = label_of(a.text) if a.kind == "deliverables" else None
        if label:
            per.setdefault(normal(label), []).append((label, a))
    return [x[0] for k, x in per.items() if len(x) > 1 or k not in tracked or is_pending(x[0][1], found.last_answer)]


def open_work(doc: dict, found: Found) -> list[str]:
    """The document's open entries, and a note on every item that they and the completed ones leave open."""
    from ledgerloom.operators.anchors import UNRECONCILED

    task = doc["task_state"]
    named = {x for e in task["open"] for x in subject_labels(e)}
    left = unresolved(found, named | {x for e in task["completed"] for x in subject_labels(e)})
    return task["open"] + [f"{label}{UNRECONCILED}" + (f" — full text: {a.pointer}" if a.pointer else "") for label, a in left if normal(label) not in named]


def render_summary(doc: dict, found: Found, uri: str | None = None, known: set[str] | None = None, compact: bool = False) -> str:
    """The checkpoint's body: anchors first, then the document's sections; addresses that can't be read give way. compact: empty sections are left out."""
    from ledgerloom.operators.artifacts import UNRESOLVABLE

    tail = lambda x: f" ({x['artifact']})" if x["artifact"] is not None else ""
    task = doc["task_state"]
    sections = [
        ("Primary Request and Intent", [task["goal"]] if task["goal"] else []), ("Current Plan", task["current_plan"]), ("Completed", task["completed"]), ("Pending Jobs", open_work(doc, found)),
        ("Decisions", [f"{x['decision']} (reason: {x['reason']})" for x in doc["decisions"]]), ("Files and Code", [f"{x['path']} — {x['operation']}{tail(x)}" for x in doc["files"]]),
        ("Tests", [f"{x['command']} → {x['status']}{' — failing: ' + ', '.join(x['failing']) if x['failing'] else ''}{tail(x)}" for x in doc["tests"]]),
        ("Errors", [f"{x['code'] + ': ' if x['code'] is not None else ''}{x['message']} ({'resolved' if x['resolved'] else 'UNRESOLVED'}){tail(x)}" for x in doc["errors"]]),
        ("Critical Context", doc["critical_facts"]), ("User Constraints", doc["user_constraints"]), ("Evidence References", list(dict.fromkeys(doc["artifact_refs"]))), ("Next Step", [doc["next_step"]] if doc["next_step"] else []),
    ]
    out = [f"<!-- schema v{doc['schema_version']} -->", HEADING, render(found, uri) or "- (none)"]
    for name, items in sections:
        if items or not (compact or name == "Evidence References"):
            out += ["", f"## {name}", "\n".join(f"- {x}" for x in items) or "- (none)"]
    text = "\n".join(out)
    return text if known is None else ADDRESS.sub(lambda m: m[0] if m[0] in known else UNRESOLVABLE, text)


def prose(text: str, found: Found, uri: str | None = None) -> str:
    """What stands in for a document that can't be read: the anchors, and the model's own words without a forged heading."""
    empty = parse('{"schema_version": 1, "task_state": {}}')
    told = re.sub(rf"^{re.escape(HEADING)}", "the Anchors section", text.strip(), flags=re.M)
    return f"{render_summary(empty, found, uri)}\n\n## Narrative (model-generated)\n{told}"


def canonical(value) -> str:
    """JSON with its keys in order of their UTF-16 units and without white space."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def redacted_text(text: str) -> tuple[str, int]:
    """A text without credentials, and how many matches gave way: the same rules and sweep as the columns'."""
    from ledgerloom.operators import redaction as R

    hits = 0

    def put(name: str, before: str, sure=None):
        def new(m: re.Match) -> str:
            nonlocal hits
            if sure and not sure(m[0]):
                return m[0]
            hits += 1
            head = re.match(before, m[0])[0] if before else ""
            return f"{head}[REDACTED:{name}:{hashlib.sha256(m[0][len(head) :].encode()).hexdigest()[:4]}]"

        return new

    for name, before, pattern in R.RULES:
        text = re.sub(pattern, put(name, before), text, flags=re.A)
    return re.sub(R.SWEEP, put("high_entropy", "", lambda m: not m.startswith("artifact://") and bits(m) >= R.BITS), text, flags=re.A), hits


def bits(token: str) -> float:
    return -sum(token.count(c) / len(token) * math.log2(token.count(c) / len(token)) for c in set(token))


def redacted_run(texts: list[str]) -> list[str]:
    """The texts of adjacent blocks without credentials, also such as are cut over several; as many texts as before.

    Where redacting each by itself doesn't do, what changed in the whole goes into the first block that it touches.
    """
    whole = "".join(texts)
    new, hits = redacted_text(whole)
    alone = [redacted_text(t)[0] for t in texts]
    if not hits or "".join(alone) == new:
        return alone if hits else texts
    same = len(os.path.commonprefix([whole, new]))
    back = len(os.path.commonprefix([whole[same:][::-1], new[same:][::-1]]))
    stop, middle = len(whole) - back, new[same : len(new) - back]
    out, at = [], 0
    for t in texts:
        a, at = at, at + len(t)
        if not t or at <= same or a >= stop:
            out.append(t)
            continue
        out.append(t[: max(0, same - a)] + middle + t[max(0, stop - a) :])
        middle = ""
    return out


def redacted_leaves(value):
    """A JSON value with every string in it redacted; keys stay."""
    if isinstance(value, str):
        return redacted_text(value)[0]
    if isinstance(value, list):
        return [redacted_leaves(x) for x in value]
    return {k: redacted_leaves(v) for k, v in value.items()} if isinstance(value, dict) else value


def holds(value, mark: str) -> bool:
    """Whether any string of a JSON value holds the mark, or the texts of blocks that stand side by side do together."""
    if isinstance(value, str):
        return mark in value
    if isinstance(value, dict):
        return any(holds(x, mark) for x in value.values())
    if not isinstance(value, list):
        return False
    texts = [x["text"] if isinstance(x, dict) and x.get("type") in ("text", "reasoning") and isinstance(x.get("text"), str) else None for x in value]
    side_by_side = ["".join(g) for k, g in itertools.groupby(texts, lambda t: t is None) if not k]
    return any(mark in t for t in side_by_side) or any(holds(x, mark) for x in value)
