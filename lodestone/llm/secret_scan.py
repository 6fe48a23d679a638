"""Secret scanning with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one transition array. Texts are cut behind bytes
that lead every state back to the start (no rule can match across them), and the pieces of a batch walk through the
array in step, each byte once for all rules. Only pieces in which some rule ended are looked at again, to read off the
leftmost non-overlapping spans with the rule's own small automaton. A private key's marker runs on over the key to its
END line.

Defined results: a null text is an empty one and has no findings; an empty table gives an empty table; repeated rows
each get their own result; texts of any length are scanned whole; columns of the input other than the named ones pass
through unread, and one that is called like an output column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.automaton import Automaton
from lodestone.llm.common import pieces, small_batches, utf8


@dataclass(frozen=True)
class Rule:
    """A match is head then body (both greedy); it counts if body has min_body and all of it min_total bytes. probe: what the combined automaton looks for, head then body if None."""

    kind: str
    head: str
    body: str
    min_body: int = 1
    min_total: int = 1
    any_case: bool = False
    probe: str | None = None


RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", min_body=6, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]+", min_total=20),
    Rule("hex", "", "[0-9a-f]+", min_total=24, probe="[0-9a-f]{24}"),
    Rule("hosting", "gh[opsu]_", "[A-Za-z0-9]+", min_body=36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", min_body=10),
    Rule("webtoken", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY", "-----"),
)
#: what follows a marker of pem: all up to its END line, or lines of base64 where that is missing
KEY_BODY = re.compile(rb"(?:(?!-----BEGIN ).)*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\\r)?(?:[ \t\r]*(?:\n|\\n)[ \t]*[A-Za-z0-9+/]{16,}={0,2})+(?:[ \t\r]*(?:\n|\\n)[ \t]*[A-Za-z0-9+/]{1,15}={1,2})?", re.S)
BASE_KINDS = ("assign", "access", "hex")

FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, lane_bytes: int = 1024):
        self.rules, self.lane = rules, lane_bytes
        self.auto = Automaton([(r.probe or r.head + r.body, r.any_case) for r in rules], search=True)
        self.heads = [Automaton([(r.head, r.any_case)], search=False) if r.head else None for r in rules]
        self.bodies = [Automaton([(r.body, r.any_case)], search=False) for r in rules]
        # read from the end, where a head and the first byte of its body end is where a match may begin
        self.begins = [Automaton([(f"{r.head}(?:{r.body})", r.any_case)], search=True, backward=True) if r.head else None for r in rules]
        self.firsts = [self._firsts(b) for b in self.bodies]
        width = self.auto.next.shape[1]
        self.flat = (self.auto.next * width).astype(np.int32).ravel()  # states are kept as offsets of their rows
        self.ends = np.repeat(self.auto.accepts, width).astype(np.min_scalar_type((1 << len(rules)) - 1))
        self.may_cut = self.auto.resets()

    @staticmethod
    def _firsts(auto: Automaton) -> frozenset:
        auto._lists()
        return frozenset(b for b in range(256) if auto.next[0][auto.classes[b]] != auto.dead)

    def lanes(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and lengths of pieces that no match crosses: texts, cut behind the first fit byte after each lane_bytes."""
        begins = [off[:-1]]
        long = np.flatnonzero(np.diff(off) > 2 * self.lane)
        if len(long):
            fit = np.flatnonzero(self.may_cut[raw]) + 1
            marks = np.concatenate([np.arange(off[i] + self.lane, off[i + 1], self.lane) for i in long])
            owner = np.repeat(off[long + 1], [len(range(int(off[i]) + self.lane, int(off[i + 1]), self.lane)) for i in long])
            at = np.searchsorted(fit, marks)
            inside = at < len(fit)
            cutting = fit[at[inside]]
            begins.append(np.unique(cutting[cutting < owner[inside]]))
        begin = np.unique(np.concatenate(begins))
        return begin, np.diff(np.append(begin, off[-1]))

    def hits(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each piece, the bits of the rules that end in it."""
        order = np.argsort(-length, kind="stable")
        start, left = begin[order], length[order]
        codes = self.auto.classes[raw]
        state = np.zeros(len(order), np.int32)
        mask = np.zeros(len(order), self.ends.dtype)
        live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        for t, n in enumerate(live):
            if n < 8:  # the few longest pieces are walked one by one
                for k in range(n):
                    mask[k] |= self._rest(codes[start[k] + t : start[k] + left[k]], int(state[k]))
                break
            s = self.flat[state[:n] + codes[start[:n] + t]]
            state[:n] = s
            e = self.ends[s]
            if e.any():
                mask[:n] |= e
        out = np.zeros_like(mask)
        out[order] = mask
        return out

    def _rest(self, codes: np.ndarray, state: int) -> int:
        """The bits of the rules that end from a state on."""
        if not hasattr(self, "_flat"):
            self._flat = self.flat.tolist()
        step, ends, out = self._flat, self.ends, 0
        walked = np.empty(min(len(codes), 1 << 16), np.int64)
        for a in range(0, len(codes), 1 << 16):
            part = codes[a : a + (1 << 16)].tolist()
            for k, c in enumerate(part):
                state = step[state + c]
                walked[k] = state
            out |= int(np.bitwise_or.reduce(ends[walked[: len(part)]]))
        return out

    def spans(self, data: bytes, rule: int) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches of a rule in bytes, without those that are too short.

        One pass from the end tells where matches begin, so no walk from the left is in vain and the time is linear.
        """
        r, head, body, found, done = self.rules[rule], self.heads[rule], self.bodies[rule], [], 0
        if head:
            places = self.begins[rule].ends_backward(data)
        else:
            firsts = self.firsts[rule]
            places = (i for i, c in enumerate(data) if c in firsts)
        for i in places:
            if i >= done:
                middle = head.longest(data, i, len(data)) if head else i
                if middle >= 0 and (end := body.longest(data, middle, len(data))) > middle:
                    if end - middle >= r.min_body and end - i >= r.min_total:
                        found.append((i, end))
                    done = end
        return found

    def scan(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Findings by text: (begin, rule, end) in bytes of the text, in order."""
        begin, length = self.lanes(raw, off)
        begin, length = begin[length > 0], length[length > 0]
        mask = self.hits(raw, begin, length)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in np.flatnonzero(mask):
            b, text = int(begin[k]), int(np.searchsorted(off, begin[k], side="right")) - 1
            data = raw[b : b + int(length[k])].tobytes()
            shift = b - int(off[text])
            for rule in range(len(self.rules)):
                if int(mask[k]) >> rule & 1:
                    for s, e in self.spans(data, rule):
                        s, e = s + shift, e + shift
                        if self.rules[rule].kind == "pem" and (body := KEY_BODY.match(raw[int(off[text]) : int(off[text + 1])].data, e)):
                            e = body.end()
                        found.setdefault(text, []).append((s, rule, e))
        return {k: sorted(v) for k, v in found.items()}


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once on the driver; tasks get the arrays."""
    return Scanner(rules)


def find_secrets(df: DataFrame, text: str = "text", out: str = "findings", rules: tuple[Rule, ...] = RULES, redact: str | None = None) -> DataFrame:
    """df with a column of findings (kind, start, end: code points, end exclusive; by start, then in the rules' order).

    With redact, each found span of the text is replaced by that string with the kind put in for {} (overlapping spans as one, the first kind names it).
    """
    kept = [c for c in df.columns if c != out]
    base = df.select(kept)
    schema = T.StructType([*base.schema.fields, T.StructField(out, FINDINGS)])
    at = kept.index(text)
    scanner = compiled(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                raw, off = utf8(part.column(at))
                found = scanner.scan(raw, off)
                rows, texts = [], {}
                for i in range(part.num_rows):
                    spans = []
                    if i in found:
                        data = raw[off[i] : off[i + 1]].tobytes()
                        points = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
                        at_point = lambda b: int(points[b - 1]) if b else 0
                        spans = [{"kind": rules[k].kind, "start": at_point(s), "end": at_point(e)} for s, k, e in found[i]]
                        if redact is not None:
                            texts[i] = _redacted(data, found[i], rules, redact)
                    rows.append(spans)
                columns = list(part.columns)
                if texts:
                    old = columns[at].cast(pa.binary()).to_pylist()
                    columns[at] = pa.array([texts[i].encode() if i in texts else x for i, x in enumerate(old)], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW)], names=[*kept, out])

    return small_batches(base).mapInArrow(run, schema)


def _redacted(data: bytes, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], by: str) -> str:
    out, done, last = [], 0, -1
    for s, k, e in spans:
        if s >= done and s > last - 1 or not out:
            out += [data[done:s], by.replace("{}", rules[k].kind).encode()]
        done = last = max(done, e)
    return b"".join([*out, data[done:]]).decode("utf-8", "replace")


def digest(findings: str = "findings") -> list:
    """The columns that sum up findings: counts of the base kinds, a hash of the base spans, all spans as text."""
    joined = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: lambda x: x["kind"] == kind
    base = F.filter(findings, lambda x: x["kind"].isin(*BASE_KINDS))
    return [
        *[F.size(F.filter(findings, of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, joined), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(findings, joined), ",").alias("spans"),
    ]
