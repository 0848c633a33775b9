"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

Fitted on the small labelled table below and on a bounded sample of documents labelled by the base
patterns; decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, crf, spans


LEAST = 5  # characters of a tagged span


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


# fixed values: the base patterns
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
ADDRESS = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"


def emails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL: what stands before an @ is taken back to its beginning, so a long run without one is passed once."""
    whole, inside = re.compile(EMAIL), re.compile("[A-Za-z0-9._%+-]").match
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and inside(text[start - 1]):
            start -= 1
        m = whole.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[re.Match]:
    """The matches of ADDRESS: a chain of numbers joined by dots is read once and holds one match for each four of them."""
    whole, number = re.compile(ADDRESS), re.compile("[0-9]++")
    for chain in re.finditer(r"[0-9]++(?:\.[0-9]++)*+", text):
        starts = [m.start() for m in number.finditer(text, *chain.span())] if chain[0].count(".") >= 3 else []
        for k in range(0, len(starts) - 3, 4):
            yield whole.match(text, starts[k])


KINDS = (
    spans.Kind("email", EMAIL, r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", lambda m: True, find=emails),
    spans.Kind(
        "ip", ADDRESS, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
        lambda m: all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))), find=addresses,
    ),
    spans.Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9]){12}", lambda m: 13 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    spans.Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m[0])) <= 15),
)
NAMES = tuple(k.name for k in KINDS)
TRIGGERS = frozenset("phone tel telephone mobile call fax mail email e-mail contact card visa mastercard credit ip host server address".split())

# labelled examples; the values are made up
LABELLED = tuple(
    spans.marked(t, NAMES)
    for t in (
        "call me at [[phone:(555) 010-4477]] after noon",
        "tel. [[phone:555-010-9921]] or fax [[phone:555-010-9922]] today",
        "phone: [[phone:030 5550 1234]] is the office",
        "mobile [[phone:+49 151 5550 123]] works best",
        "contact [[email:jane.doe@mail.example]] or [[email:info@shop.example.org]] please",
        "mail to [[email:john@localhost]] from the host",
        "write to [[email:anna[at]mail.example]] soon",
        "paid with visa [[card:4929 3483 8514 6306]] in May",
        "credit card [[card:4111-1111-1111-1111]] was declined",
        "card number [[card:378282246310005]] expires soon",
        "server [[ip:173.33.203.46]] answered, [[ip:10.0.0.7]] did not",
        "host address [[ip:2001:db8::ff00:42:8329]] is new",
        "version 10.4.2 of section 3.1.4 has 12345 lines and 2048 tokens",
        "on 2024-11-03 at 10:30 we sold 1,234 pieces for 99.95 in 2023",
        "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 is no card",
        "order 1234567890123456 shipped as 99-12-4421 to gate 7",
        "see https://example.org/a?id=12345 and mention @someone or a+b",
        "Heerha!!! THE!! ONER%%% table | cell | other | Ndesat | tieser",
    )
)


def features(word: str) -> tuple[str, ...]:
    core = word.strip("\"',;:[]{}=!?|<>`").rstrip(".")
    if core.isalpha():
        low = core.lower()
        return ("plain", "w=" + low) if low in TRIGGERS else ("plain",)
    number = _digits(core)
    out = ["s=" + crf.shape(core), f"digits={min(len(number), 20)}", "all" if len(number) == len(core) else "part"]
    if core.startswith("+"):
        out.append("plus")
    if "@" in core or "[at]" in core:
        out += ["at", "dotted" if "." in core.rpartition("@")[2] else "bare"]
    if 13 <= len(number) <= 19:
        out.append("luhn" if luhn(number) else "no luhn")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts):
        out.append("quad")
    if core.lower() in TRIGGERS:
        out.append("w=" + core.lower())
    return tuple(out)


def train(docs: DataFrame, rows: int = spans.SAMPLE, labelled=LABELLED) -> crf.Model:
    """A fitted field; ``docs`` has doc_id and text, of which 2 * ``rows`` documents at most are used."""
    examples = [(text, crf.tokens_of(text, own)) for text, own in labelled]
    for text in spans.sample(docs, KINDS, rows):
        own = sorted((s, e, k + 1) for k, s, e, _, _ in spans.base(KINDS, text, [True] * len(KINDS)))
        examples.append((text, crf.tokens_of(text, own)))
    labels = ["O"] + [f"{p}-{n}" for n in NAMES for p in "BI"]
    return crf.Model(labels, features, 8).fit(examples)


def scan(docs: DataFrame, model: crf.Model | None = None, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_tagged), one row per row of ``docs``.

    ``spans`` joins kind:start:end of base spans and, where no base span covers them, of tagged ones, by kind, then start.
    Tagged spans of fewer than ``least`` characters are left out. A null text is empty; ids may be null or repeated; a text of
    any length is scanned whole, in time linear in it.
    """
    rows = spans.prepared(docs, text_col)
    model = model or train(rows)
    kept = lambda _, value: len(value) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            n = batch.num_rows
            counts = np.zeros((n, len(KINDS)), dtype=np.int64)
            tagged = np.zeros(n, dtype=np.int64)
            sha, joined = [spans.digest([])] * n, [""] * n
            for row, own, more in spans.found(model, KINDS, batch.column(1), NAMES, kept):
                more = spans.beside(own, more)
                for k, *_ in own:
                    counts[row, k] += 1
                tagged[row] = len(more)
                listed = sorted((k, s, e) for k, s, e, _, _ in own)
                sha[row] = spans.digest([f"{NAMES[k]}:{s}:{e}" for k, s, e in listed])
                listed = sorted(listed + [(NAMES.index(name), s, e) for s, e, name in more])
                joined[row] = ",".join(f"{NAMES[k]}:{s}:{e}" for k, s, e in listed)
            yield common.batch_of(
                doc_id=batch.column(0), n_email=counts[:, 0], n_ip=counts[:, 1], n_card=counts[:, 2], n_phone=counts[:, 3],
                base_sha256=sha, spans=joined, n_tagged=tagged,
            )

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_tagged long")
