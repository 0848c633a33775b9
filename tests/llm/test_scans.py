"""Secret, personal-data and license scans, URL decisions and decontamination against plain versions."""

import hashlib
import random
import re
import time
from urllib.parse import urljoin

import pytest

from subscope.llm import crf, decontamination, licenses, pii, secret_scan, spans, url_filter
from subscope.llm import queries as q

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(found):
    return hashlib.sha256(",".join(found).encode()).hexdigest()


def secrets_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return sorted(out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15])


def test_secrets_base_spans(spark, texts, sf_dir):
    names = ["assign", "access", "hex"]
    for r in q.op2_secret_scan(spark, sf_dir).collect():
        want = secrets_of(texts[r.doc_id])
        listed = [f"{names[k]}:{s}:{e}" for s, k, e in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == sha(listed) and set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_personal_base_spans(spark, texts, sf_dir):
    for r in q.op9_pii(spark, sf_dir).collect():
        want = personal(texts[r.doc_id])
        listed = [f"{pii.NAMES[k]}:{s}:{e}" for k, s, e in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in want) for i in range(4))
        assert r.base_sha256 == sha(listed) and set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_fields_find_what_the_patterns_miss(spark, docs):
    new = [
        (1, "please log in with password\n[not] bearer 7fK2mQ9xT1vB4nL8pR3zW5 in the header of it"),
        (2, "the plain words of a password policy and a token of thanks are no secret here"),
        (3, "pay with card 4929 3483 8514 6307 or call (555) 010-4477 now"),
    ]
    df = spark.createDataFrame(new, "doc_id long, text string")
    rows = docs.select("doc_id", "text")
    secret = {r.doc_id: r for r in secret_scan.scan(df, secret_scan.train(rows)).collect()}
    assert "secret:" in secret[1].spans and not secret[2].spans
    found = {r.doc_id: r for r in pii.scan(df, pii.train(rows)).collect()}
    assert found[3].n_tagged and not found[2].spans


def test_held_out_documents_are_tagged_like_the_patterns(spark):
    """Trained on one half of the documents, tried on the other."""
    import pyarrow as pa

    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    half = rows.where("doc_id % 2 = 1")
    other = [r.text for r in rows.where("doc_id % 4 = 0").collect()]
    for module, of in ((secret_scan, lambda b, t: not t[b[3] : b[4]].isdigit()), (pii, lambda b, t: True)):
        model = module.train(half)
        tagged = {}
        for row, a, b, _ in model.decode(pa.array(other, pa.large_string())):
            tagged.setdefault(row, []).append((a, b))
        hit = total = 0
        for row, text in enumerate(other):
            own = [b for b in spans.base(module.KINDS, text, [True] * 4) if of(b, text)]
            for a, b, _ in set(crf.tokens_of(text, [(x[3], x[4], 1) for x in own])):
                total += 1
                hit += any(s < b and e > a for s, e in tagged.get(row, []))
        assert hit >= 0.9 * total and sum(map(len, tagged.values())) <= 1.2 * total + 2


def test_pruned_decoding_is_viterbi(spark, docs, texts):
    import numpy as np
    import pyarrow as pa

    model = pii.train(docs.select("doc_id", "text"))
    some = [t for t in list(texts.values())[:40]] + ["", "+1 (980) 555-6268", "a 4929 3483 8514 6306 b"]
    column = pa.array(some, pa.large_string())
    found = model.decode(column)
    for row, text in enumerate(some):
        words = crf.TOKEN.findall(text)
        if not words:
            continue
        r = model.rows(words)
        files = model.file_rows(words, np.arange(len(words)), np.array([0, len(words)]))[0]
        score = model._tables[r, 0] + model._tables[np.append(0, r[:-1]), 1] + model._tables[np.append(r[1:], 0), 2] + model.file_weights[files].sum(0)
        tags = model._viterbi(score[None])[0]
        inside = {t for d, a, b, _ in found if d == row for t in range(a, b)}
        assert inside == set(np.flatnonzero(tags).tolist())


def test_address_parts_of_any_length():
    zeros = "0" * 6000
    text = f"{zeros}.1.2.{zeros}7 1.2.3.256 9.9.9.{'9' * 6000} 10.0.0.255"
    assert [s for k, s, *_ in spans.base(pii.KINDS, text, [True] * 4) if k == 1] == [0, text.index("10.0.0.255")]


def test_personal_data_in_long_runs():
    """The linear searches find what the patterns find, on text made of their letters, and pass runs of a million in a second."""
    rng = random.Random(8)
    for letters in ("a1@..-_%+ ", "12.. -+(", "a@b.@.", "0.1.2.3.4"):
        for _ in range(400):
            text = "".join(rng.choices(letters, k=rng.randrange(1, 60)))
            for kind in pii.KINDS:
                assert [m.span() for m in kind.matches(text)] == [m.span() for m in re.finditer(kind.pattern, text)], text
    long = " ".join(["x" * 10**6, "a.b@c.example", "7" * 10**6, "10.0.0.255", "1." * 500_000, "+1((" + "(" * 10**6, "-" * 10**6])
    began = time.process_time()
    found = spans.base(pii.KINDS, long, [True] * 4)
    assert time.process_time() - began < 5
    assert [k for k, *_ in found if k < 2][:2] == [0, 1] and long[found[0][1] : found[0][2]] == "a.b@c.example"


def test_redaction(spark, docs, odd):
    rows = [(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', 9), (2, "card 4929348385146306 stays", 9), (3, None, None), (4, "clean", 77)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    model = secret_scan.train(docs.select("doc_id", "text"))
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(df, model).collect()}
    assert out[1] == ('x token = "[SECRET]" y', 22) and out[2] == (rows[1][1], 9) and out[3] == (None, None) and out[4] == ("clean", 77)
    assert sorted(map(str, secret_scan.redact(odd, model).collect())) == sorted(map(str, odd.collect()))


def test_scans_of_odd_rows(spark, odd):
    for scan in (secret_scan.scan, pii.scan):
        out = scan(odd).collect()
        assert len(out) == odd.count() and all(r.base_sha256 == sha([]) for r in out if r.doc_id in (1, 2, 3))
        assert scan(odd.where("false")).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def license_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, places, base, found, best = WORD.findall(low), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += here
        base |= {label} if here else set()
    for label, template in licenses.TEMPLATES:
        tokens, span = set(licenses.token_set(template)), 2 * len(WORD.findall(template.lower()))
        # every run of twice the template's words; runs that lie in another one hold no more
        shared = max((len(tokens.intersection(words[i : i + span])) for i in range(max(1, len(words) - span + 1))), default=0)
        if shared >= licenses.THRESHOLD * len(tokens) - 1e-9:
            found.add(label)
            best = max(best, shared / len(tokens))
    join = lambda x: ",".join(sorted(x))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(base | found), 1.0 if places else best


def test_licenses(spark, texts, odd, sf_dir):
    for r in q.op7_license_scan(spark, sf_dir).collect():
        assert tuple(r)[1:] == license_of(texts[r.doc_id])
    rng = random.Random(6)
    vocabulary = "cc by all rights reserved general public license the under licensed apache version 2 0 mit released K İ Straße".split()
    made = [(i, rng.choice([" ", "-", "\n", "  "]).join(rng.choices(vocabulary, k=rng.randrange(1, 30))).upper()) for i in range(200)]
    made += [(900 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    for i, (_, text) in enumerate(licenses.TEMPLATES):  # wrapped, stretched and cut notices at any place of longer texts
        for k in range(12):
            gap = rng.choice(["\n", " ", " lo ", "\n * ", " lo mi ", " lo mi na "])
            notice = gap.join(w for w in text.split() if rng.random() < 0.97)
            around = [" ".join(rng.choices(["lo", "mi", "na", "the", "of"], k=rng.randrange(130))) for _ in range(2)]
            made.append((1000 + 100 * i + k, around[0] + "\n" + notice + " " + around[1]))
    for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect():
        assert tuple(r)[1:] == license_of(dict(made)[r.doc_id]), dict(made)[r.doc_id]
    out = licenses.scan(odd).collect()
    assert len(out) == odd.count() and {tuple(r)[1:] for r in out if r.doc_id in (1, 2, 3)} == {(0, 0, None, None, "", "", 0.0)}
    assert licenses.scan(odd.where("false")).count() == 0


def test_urls(spark):
    pages = [
        (1, "http://a.example.net/x", "<link rel=canonical href='http://b.test/y'>", "block", "net/"),
        (2, "http://b.test/y/", "", "block", None),
        (3, "https://c.test/1", '<meta http-equiv="refresh" content="0; url=http://b.test/y#z">', "block", None),
        (4, None, None, "allow", None),
        (5, "nourl", "", "allow", None),
        (6, "HTTP://q.Example.NET/en/a?x#y", "", "allow", "example.net/en/"),
        (7, "http://d.org/fr/1", "<link rel='canonical' href='http://e.test/'>", "allow", "org/fr/"),
        (8, "http://f.net/1", "<link rel='canonical' href='//e.test/'>", "block", "net/"),
        (9, "http://e.test", "", "allow", None),  # blocked and allowed aliases: the allow takes precedence
        (9, "http://e.test", "", "allow", None),
        (None, "http://x.org/?a://b.net/", "", "allow", None),
        (11, "http://internet/", "", "allow", None),
        (12, "http://net", "", "allow", None),  # an empty path does not start with the rule's
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string, rule string")
    out = sorted(((r.page_id or 0, r.verdict, r.rule or "") for r in url_filter.judge(df).collect()))
    assert out == sorted((i or 0, v, r or "") for i, _, _, v, r in pages)
    far = spark.createDataFrame([("http://c.test/1", "http://far.test/"), (None, "x"), ("http://l.test/", "http://l.test/")], "from_url string, to_url string")
    more = df.union(spark.createDataFrame([(20, "http://far.test/", None, "", "")], df.schema))
    assert {r.page_id: r.verdict for r in url_filter.judge(more, redirects=far).collect()}[20] == "block"
    assert url_filter.judge(df.where("false")).count() == 0


def test_links(spark):
    """Targets of every kind against the standard library, several links of a page, escaped and oddly written tags."""
    base = "http://Shop.test/a/b/c.html?x=1#f"
    targets = ["page2.html", "../x", "../../../y/./z?q=../w", "?id=1", "/root", "//other.test/p", "https://abs.test/q?u=http://in.test/", "./", "sub/dir/", "..", "e;p=1?a&b"]
    rows = [(base, f"<LINK class=x href='{t}' REL='nofollow Canonical'>") for t in targets]
    rows += [("http://bare.test", '<link rel=canonical href="x/y">'), ("https://q.test?z", "<link rel=canonical href=/n><link rel='canonical' href='m'/>")]
    rows += [(base, '<meta content="5; URL=go.html?a=1&amp;b=2" http-equiv=Refresh><link href="c&#38;d" rel="canonical">')]
    rows += [(base, f'<link rel="canonical" href="{t}">') for t in ("#top", "mailto:a@b.test", "", "javascript:x()")]
    rows += [(base, "<link rel='stylesheet' href='canonical.css'><meta name=x content='url=no'>"), (None, rows[0][1]), ("nourl", rows[0][1]), (base, None), (base, "")]
    got = sorted((r.from_url, r.to_url) for r in url_filter.links(spark.createDataFrame(rows, "url string, html string")).collect())
    want = [(base, urljoin(base, t)) for t in targets] + [("http://bare.test", "http://bare.test/x/y"), ("https://q.test?z", "https://q.test/n"), ("https://q.test?z", "https://q.test/m")]
    want += [(base, "http://Shop.test/a/b/go.html?a=1&b=2"), (base, "http://Shop.test/a/b/c&d")]
    plain = lambda pairs: sorted((a, b.rstrip("/")) for a, b in pairs)
    assert plain(got) == plain(want)
    pages = spark.createDataFrame([(1, "http://a.net/x/y", "<link rel=canonical href='../z'>"), (2, "http://a.net/z", None), (3, "http://b.test/p", "<link rel=canonical href=q><link rel=canonical href='http://a.net/z'>"), (4, "http://b.test/q", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages).collect()} == dict.fromkeys((1, 2, 3, 4), "block")


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def edit_distance_within(window, text):
    """Fewest edits of the window against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        left, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(left[j - 1] + (c != d), left[j] + 1, row[j - 1] + 1))
    return min(row)


def test_leaks_are_found_and_clean_texts_are_not(spark, texts, items, sf_dir):
    got = {(r.doc_id, r.item_id) for r in q.op4_benchmark_decontamination(spark, sf_dir).collect()}
    whole = {(i, k) for i, t in texts.items() for k, b in items if decontamination.normal(b) in decontamination.normal(t)}
    assert whole <= got
    index = decontamination.Index(items)
    for i, k in got - whole:
        text = decontamination.normal(texts[i])
        own = [w for w in range(len(index.windows)) if index.item[w] == k]
        assert any(edit_distance_within(index.windows[w], text) <= index.edits[w] for w in own)


def test_edit_budget_equals_brute_force(texts, items):
    rng = random.Random(9)
    index = decontamination.Index(items[:6])
    for trial in range(60):
        w = rng.randrange(len(index.windows))
        piece = list(index.windows[w].decode(errors="replace"))
        for _ in range(rng.randrange(0, 2 * int(index.edits[w]) + 3)):
            at = rng.randrange(len(piece))
            piece[at] = rng.choice(["", "q", piece[at] + "z"])
        text = decontamination.normal(rng.choice(list(texts.values()))[:300] + " " + "".join(piece) + " tail of it")
        found = {x[0] for x in decontamination.matches(index, text)}
        want = {index.item[k] for k in range(len(index.windows)) if edit_distance_within(index.windows[k], text) <= index.edits[k]}
        assert found == want


def test_decontamination_of_odd_rows(spark, odd, items):
    bench = spark.createDataFrame([*items[:5], (None, "x"), (8, None), (9, "short")], "item_id long, text string")
    assert decontamination.find(odd, bench).count() == 0
    assert sorted(map(str, decontamination.clean(odd, bench).collect())) == sorted(map(str, odd.collect()))
    assert decontamination.find(odd, bench.where("false")).count() == 0 and decontamination.clean(odd.where("false"), bench).count() == 0
    twice = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (None, items[0][1].upper().replace(" ", "\n"))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontamination.find(twice, bench).collect()) == [(0, items[0][0]), (1, items[0][0]), (1, items[0][0])]


def test_passages_cut_at_any_offset(spark, sf_dir):
    """Passages of the stated length, wherever they were cut from a longer item, in plain surroundings."""
    rng = random.Random(12)
    made = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(130))) for k in range(4)]
    made.append((4, " ".join(f"w{k}" for k in range(44))))  # a window and a little more
    plain = " ".join(f"{k}.{k * k}" for k in range(60))
    index = decontamination.Index(made)
    rows, want = [], set()
    for item, text in made:
        data = decontamination.normal(text).decode()
        for _ in range(60):
            n = rng.randrange(decontamination.PASSAGE, min(len(data), 260) + 1)
            at = rng.randrange(len(data) - n + 1)
            rows.append((len(rows), f"{plain} {data[at : at + n]} {plain}"))
            want.add((len(rows) - 1, item))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(made, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find(df, bench).collect()} == want
    assert decontamination.clean(df, bench).count() == 0
    # a long text is searched in pieces that overlap
    data = decontamination.normal(made[0][1])[301:460]
    for at in range(decontamination.PIECE - 200, decontamination.PIECE + 400, 37):
        assert {m[0] for m in decontamination.matches(index, b"1 " * (at // 2) + data + b" 2" * 300)} == {0}


def test_every_found_secret_is_redacted_whole(spark, docs):
    """Assigned digits, tagged spans that reach beyond a base span, and digit runs inside a tagged span."""
    rows = [
        (1, "x password=123456789012 y"),
        (2, 'then password="abcdefghijkl$rest9" z'),
        (3, "use bearer sk_1234567890123456 in the header"),
        (4, "card 4929348385146306 stays"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.train(docs.select("doc_id", "text"))
    tags = {1: [], 2: [(1, 2)], 3: [(2, 3)], 4: []}  # (first token, end): what a field tags, fixed here

    class Fixed:
        def decode(self, column):
            texts = column.to_pylist()
            return [(i, a, b, 1) for i, t in enumerate(texts) for k, r in rows if r == t for a, b in tags[k]]
    out = {r.doc_id: r.text for r in secret_scan.redact(df, Fixed()).collect()}
    assert out == {1: "x password=[SECRET] y", 2: 'then password="[SECRET]" z', 3: "use bearer [SECRET] in the header", 4: rows[3][1]}
    found = {r.doc_id: r.spans.split(",") for r in secret_scan.scan(df, Fixed()).collect()}
    assert "secret:11:30" in found[3] and "hex:14:30" in found[3] and any(s.startswith("secret:") for s in found[2])
    fitted = {r.doc_id: r.text for r in secret_scan.redact(df, model).collect()}
    assert fitted[1] == out[1] and fitted[4] == rows[3][1]
    text, own = "mail a.b@c.example/x9 or d@e.org", [(0, 5, 18, 5, 18), (0, 25, 32, 25, 32)]
    assert spans.beside(own, [(5, 21, "email"), (25, 32, "email")]) == [(5, 21, "email")] and text[5:18] == "a.b@c.example"


def test_wrapped_license_notices(spark):
    """Every template set in short lines, as in source files, is found with its label and score."""
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        lines = [" * " + " ".join(words[k : k + 3]) for k in range(0, len(words), 3)]
        rows.append((i, "\n".join(["some words before", *lines, " * and after it"])))
    rows.append((99, "\n".join(w + " word" * 9 for w in licenses.TEMPLATES[3][1].split())))  # the same words, far apart
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in out[i].labels.split(",") and out[i].score == 1.0
    assert out[99].labels == "" and out[99].score == 0.0


def test_training_rows(spark, docs):
    """The rows of the least hashes, whether few or all documents have to be searched for them."""
    rows = docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(20)).na.fill("")
    hashed = {r.h: r.text for r in rows.selectExpr("xxhash64(doc_id, text) h", "text").collect()}
    may = [h for h, t in hashed.items() if any(re.search(k.maybe, t) for k in secret_scan.KINDS)]
    for count in (1, 3, len(may) + 5):
        want = {*sorted(hashed)[:count], *sorted(may)[:count]}
        assert spans.sample(rows, secret_scan.KINDS, count) == [hashed[h] for h in sorted(want)]
    assert spans.sample(rows.where("false"), secret_scan.KINDS) == []
