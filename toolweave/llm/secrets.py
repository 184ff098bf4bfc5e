"""Secret scan: Aho-Corasick keyword prefilter, anchored rules, checksums.

One pass of an Aho-Corasick automaton over the lower-cased text finds where a
rule's keyword stands. Only there the rule's regular expression is tried,
anchored at the hit; a candidate with an embedded checksum is kept only if the
checksum holds. Long runs of hex digits have no keyword of their own, so the
text is projected on the alphabet {hex digit, other} and the keyword is a run
of 24 hex digits of that projection. A private key's span runs on from its
header to the matching END line, or to the end of its base64 lines.

Defined cases: null or empty text has no spans; texts are scanned whole;
repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import map_batches, texts_of

#: (start, end, kind), code points, end exclusive
Span = tuple[int, int, str]

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """CRC-32 of a token's random part in six base-62 digits."""
    n, digits = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits


def _crc_token(m: re.Match) -> bool:
    return crc_base62(m["body"]) == m["check"]


def _json_web_token(m: re.Match) -> bool:
    part = m["head"]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


#: What follows a key's header: fields, then base64 lines, of which the last may be short; line feeds may be escaped.
_KEY_BODY = re.compile(r"(?:(?:\s|\\[rn])++[A-Z][A-Za-z-]*+:[^\r\n\\]*+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:(?:\s|\\[rn])++[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?:[\r\n]|\\[rn]|[\"']|\Z)))?+")


def _key_end(text: str, m: re.Match) -> int:
    """Where a private key ends: after the END line of its kind before the next BEGIN, else after its base64 lines."""
    after = text.find("-----BEGIN ", m.end())
    footer = f"-----END {m['type']}PRIVATE KEY-----"
    at = text.find(footer, m.end(), after if after >= 0 else len(text))
    return at + len(footer) if at >= 0 else _KEY_BODY.match(text, m.end()).end()


class Rule:
    """A kind of secret: keywords (lower case), anchored pattern, validation, where its span ends if not with the match.

    ``run`` matches what a failed match at one hit has read in vain: hits inside
    it fail for the same reason and are not tried.
    """

    def __init__(self, kind: str, keywords: list[str], pattern: str, valid: Callable[[re.Match], bool] | None = None, end: Callable[[str, re.Match], int] | None = None, run: str | None = None):
        self.kind, self.keywords, self.pattern, self.valid, self.end = kind, keywords, re.compile(pattern, re.ASCII), valid, end
        self.run = re.compile(run, re.ASCII) if run else None


# The base rules of the result's definition, then issuers' public token formats.
RULES = [
    Rule("assign", ["password", "passwd", "secret", "token", "apikey", "api_key"], r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    Rule("access", ["akia"], r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", [], r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    Rule("github", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"gh[pousr]_(?P<body>[A-Za-z0-9]{30})(?P<check>[A-Za-z0-9]{6})(?![A-Za-z0-9])", _crc_token),
    Rule("npm", ["npm_"], r"npm_(?P<body>[A-Za-z0-9]{30})(?P<check>[A-Za-z0-9]{6})(?![A-Za-z0-9])", _crc_token),
    Rule("jwt", ["eyj"], r"(?P<head>eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", _json_web_token, run=r"eyJ[A-Za-z0-9_-]+"),
    Rule("slack", ["xox"], r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", ["aiza"], r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    Rule("private_key", ["-----begin"], r"-----BEGIN (?P<type>(?:[A-Z]+ )*)PRIVATE KEY-----", end=_key_end),
]
KINDS = [r.kind for r in RULES]
BASE = KINDS[:3]
_HEX = RULES[2]
_HEX_RUN = b"h" * 24
_HEX_CLASS = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


class Scanner:
    """Built once per task; ``spans`` scans one whole text."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = RULES if rules is None else rules
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[Rule]] = {}
        for rule in self.rules:
            for word in rule.keywords:
                owners.setdefault(word, []).append(rule)
        for word, of in owners.items():
            self.automaton.add_word(word, (len(word), of))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        ascii_only = len(data) == len(text)
        hits: dict[str, list[int]] = {}
        rules: dict[str, Rule] = {}
        for end, (n, of) in self.automaton.iter(data.lower().decode("utf-8", "surrogatepass")):
            for rule in of:
                hits.setdefault(rule.kind, []).append(end - n + 1)
                rules[rule.kind] = rule
        found: list[Span] = []
        for kind, starts in hits.items():
            rule, free = rules[kind], 0
            for at in sorted(set(starts)):
                # a match that fails validation has still used up its characters
                if at < free:
                    continue
                if not (m := rule.pattern.match(text, at)):
                    free = r.end() if rule.run and (r := rule.run.match(text, at)) else free
                else:
                    end = rule.end(text, m) if rule.end else m.end()
                    free = max(free, end)
                    if rule.valid is None or rule.valid(m):
                        found.append((at, end, kind))
        if _HEX in self.rules:
            flat, at, start, done = data.translate(_HEX_CLASS), 0, 0, 0
            while (at := flat.find(_HEX_RUN, at)) >= 0:
                # code points before the hit, counted on from the last one
                start = at if ascii_only else start + len(data[done:at].decode("utf-8", "surrogatepass"))
                m = _HEX.pattern.match(text, start)
                found.append((start, m.end(), _HEX.kind))
                done, at = at, at + m.end() - start
        order = {k: i for i, k in enumerate(KINDS)}
        return sorted(found, key=lambda s: (s[0], order.get(s[2], len(order)), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each group of overlapping spans replaced by a mark naming the first kind."""
    out, free, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[free:start], f"[{kind}]"]
        free, i = end, i + 1
    return "".join(out) + text[free:]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``secrets``, an array of (kind, start, end) by start.

    Spans are code points, end exclusive. Null and empty texts have an empty array.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        scanner = Scanner()
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[{"kind": k, "start": a, "end": b} for a, b, k in scanner.spans(t)] for t in texts_of(batch, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], ["id", "secrets"])

        return work

    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a digest of the base spans and the joined list of all spans, per row of ``scan_secrets``."""
    found = scan_secrets(df, id_col, text_col)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        id_col,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text(of(*BASE)), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked and the length column brought up to date.

    A null text stays null, an empty one empty. Clean rows come through
    unchanged, rows that repeat change alike, an empty table stays empty. Where
    spans overlap one mark, of the first kind, stands for all of them.
    """
    names = docs.columns
    at = names.index(text_col)

    def start():
        scanner = Scanner()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t and (redact(t, s) if (s := scanner.spans(t)) else t) for t in batch.column(at).to_pylist()]
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            return pa.RecordBatch.from_arrays(cols, names)

        return work

    out = map_batches(docs, start, docs.schema)
    if length_col in names:
        n = F.length(text_col)
        out = out.withColumn(length_col, F.coalesce(n, F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out
