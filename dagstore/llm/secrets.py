"""Secret scans: base patterns, and a token-efficiency test for random strings.

Random strings compress badly: a byte-level BPE vocabulary needs a token for every one or two of their
characters.  A candidate is a run of URL-safe or base64 characters of at least MIN_CHARS with a letter; it is excluded
when it is a known digest (hex of a digest's length), a UUID, or an identifier (words joined by - _ / or camel case,
each of which the vocabulary spells in few tokens, be it in lower case; numbers between them don't count); what
remains and has fewer than MAX_RATIO characters per token is reported as kind ``random``.

Spans are whole matches in code points, end exclusive.  Defined results: null is the empty text, with no spans;
repeated rows repeat; an empty table gives an empty table; whole texts are scanned however long.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame

from dagstore.llm import runtime as rt

KINDS = ("assign", "access", "hex", "random")
MIN_CHARS, MAX_RATIO = 20, 2.2
MIN_RUN = 4  # characters of an identifier's words and numbers, on average

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % MIN_CHARS)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []  # a keyword of ASSIGN is followed by : or =, so a text without either can't match
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def known(s: str) -> bool:
    """A digest or a UUID."""
    return bool(UUID.fullmatch(s) or (len(s) in DIGEST_CHARS and DIGEST.fullmatch(s)))


class TokenEfficiency:
    """Characters per token under a tiktoken vocabulary file."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, s: str) -> float:
        return len(s) / max(1, len(self.encoding.encode_ordinary(s)))

    def identifier(self, s: str, max_ratio: float) -> bool:
        """Runs of MIN_RUN characters on average whose words are each one token or of max_ratio characters a token."""
        parts = WORDS.findall(s)
        if not parts or sum(map(len, parts)) < MIN_RUN * len(parts):
            return False
        return all(p.isdigit() or self._word(p, max_ratio) or self._word(p.lower(), max_ratio) for p in parts)

    def _word(self, part: str, max_ratio: float) -> bool:
        n = len(self.encoding.encode_ordinary(part))
        return n == 1 or len(part) >= max_ratio * n


def random_spans(text: str, test: TokenEfficiency, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if any(c.isalpha() for c in s) and not known(s) and test.ratio(s) < max_ratio and not test.identifier(s, max_ratio):
            out.append(("random", m.start(), m.end()))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """id, spans array<struct<kind, start, end>> in order of start and kind, one row per input row."""
    ddl = f"{id_col} {dict(df.dtypes)[id_col]}, spans array<struct<kind:string,start:int,end:int>>"

    schema = rt.arrow_schema(ddl)

    def run(batches):
        test = None
        for b in rt.slices(batches):
            if test is None:
                path, pat = (vocabulary, pattern) if vocabulary else default_vocabulary()
                test = TokenEfficiency(path, pat or default_vocabulary()[1])
            found = [ordered(base_spans(t or "") + random_spans(t or "", test, max_ratio)) for t in b.column(1).to_pylist()]
            yield rt.to_batch(schema, [b.column(0).to_pylist(), [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found]])

    return rt.map_arrow(rt.only(df, id_col, text_col), run, ddl)


def digest(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """scan() as counts of the base kinds, the digest of the base spans and all spans as one string."""
    from pyspark.sql import functions as F

    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"] != "random")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return scan(df, id_col, **options).select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(s, text)).alias("spans"),
    )


def redact(df: DataFrame, mark: str = "[REDACTED]", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """df with every span (overlapping ones together) replaced by mark, and n_chars brought up to date; a null text stays null."""
    names, types = df.columns, dict(df.dtypes)
    ddl = ", ".join(f"`{n}` {types[n]}" for n in names)
    at, n_at = names.index(text_col), names.index(length_col) if length_col in names else None
    vocabulary, pattern, max_ratio = options.get("vocabulary"), options.get("pattern"), options.get("max_ratio", MAX_RATIO)

    schema = rt.arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        test = None
        for b in rt.slices(batches):
            if test is None:
                path, pat = (vocabulary, pattern) if vocabulary else default_vocabulary()
                test = TokenEfficiency(path, pat or default_vocabulary()[1])
            texts, counts = b.column(at).to_pylist(), b.column(n_at).to_pylist() if n_at is not None else None
            for i, t in enumerate(texts):
                spans = sorted((x, y) for _, x, y in base_spans(t) + random_spans(t, test, max_ratio)) if t else []
                if spans:
                    parts, end = [], 0
                    for x, y in spans:
                        if x >= end:
                            parts += [t[end:x], mark]
                        end = max(end, y)
                    texts[i] = "".join(parts) + t[end:]
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns = list(b.columns)
            columns[at] = pa.array(texts, schema.field(at).type)
            if n_at is not None:
                columns[n_at] = pa.array(counts, schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rt.map_arrow(df, run, ddl)


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(joined(ordered(base_spans(text or ""))).encode()).hexdigest()
