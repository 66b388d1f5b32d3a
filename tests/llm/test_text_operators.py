import hashlib
import random
import re

from pyspark.sql import functions as F

from clausemill.llm import chat_format, decontamination, licenses, pii
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


# --- decontamination


def similarity(item, window):
    """The best local alignment by trying every stretch and every common subsequence length."""
    m, best = len(item), 0.0
    for i in range(len(window)):
        for j in range(i + 1, len(window) + 1):
            part = window[i:j]
            row = [0] * (len(part) + 1)
            for a in item:
                prev = 0
                for k, b in enumerate(part, 1):
                    prev, row[k] = row[k], prev + 1 if a == b else max(row[k], row[k - 1])
            best = max(best, row[-1] / max(m, j - i))
    return best


def test_alignment_of_copies():
    item = tuple("a b c d e f g h i j".split())
    assert decontamination.align(item, ("x", *item, "y")) == (1.0, 1, 11)
    edited = tuple("x a b c D e f g h i j y".split())
    score, start, end = decontamination.align(item, edited)
    assert (score, start, end) == (0.9, 1, 11) and abs(similarity(item, edited) - 0.9) < 1e-9
    inserted = tuple("a b c d NEW e f g h i j".split())
    assert abs(decontamination.align(item, inserted)[0] - 10 / 11) < 1e-9
    assert decontamination.align(item, ("q",) * 5) == (0.0, 0, 0)


def test_seeds_find_what_alignment_of_everything_finds(spark):
    random.seed(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(vocab, k=random.randrange(15, 40)))) for i in range(12)]
    rows, want = [], set()
    for d in range(80):
        w = random.choices(vocab, k=120)
        if d % 2:
            i, text = random.choice(items)
            t = text.split()
            for k in random.sample(range(len(t)), int(random.choice([0, 0.1, 0.19]) * len(t))):
                t[k] = "zz%d" % k
            at = random.randrange(100)
            w[at:at] = t
            want.add((d, i))
        rows.append((d, " ".join(w), "en"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts = {d: decontamination.words_of(t) for d, t, _ in rows}
    for r in got:
        item = tuple(decontamination.words_of(dict(items)[r.item_id]))
        assert abs(decontamination.align(item, tuple(texts[r.doc_id]))[0] - r.similarity) < 1e-9


def test_decontamination_edges(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    rows = [(1, None, "x"), (2, "", "x"), (3, "ALPHA, beta gamma; delta epsilon zeta eta theta iota!", "x"), (None, "alpha beta gamma delta epsilon zeta eta theta iota", "x"), (4, "so two words here", "x"), (4, "so two words here", "x"), (5, "filler " * 50_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("item", F.lit(0)).withColumn("seed", F.lit(0))
    got = decontamination.contaminated(df, b).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == [(3, 1), (4, 4), (4, 4), (None, 1)]
    assert decontamination.contaminated(df.limit(0), b).count() == 0
    assert decontamination.contaminated(df, b.limit(0)).count() == 0


def test_copies_with_words_lost_and_added_match_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items, rows = [], []
    for i, m in enumerate([4, 5, 6, 9, 9, 10, 14, 14, 19, 24, 29, 34]):
        items.append((i, [f"i{i}w{k}" if k % 3 else rng.choice(vocab) for k in range(m)]))
    for i, item in items:
        m = len(item)
        for lost in range(m // 5 + 1):
            for added in range(m // 4 + 2):
                for even in (False, True):  # spread, or anywhere
                    n = lost + added
                    at = [round((k + 1) * m / (n + 1)) for k in range(n)] if even else sorted(rng.choices(range(1, m), k=n))
                    drop = set(rng.sample(at, lost)) if lost else set()
                    copy: list[str] = []
                    for p, w in enumerate(item):
                        copy += ["new"] * (at.count(p) - (p in drop)) + ([] if p in drop else [w])
                    rows.append((len(rows), " ".join(rng.choices(vocab, k=6) + copy + rng.choices(vocab, k=3) + item[-1:] + rng.choices(vocab, k=3)), "en"))
    want = {
        (d, i) for d, t, _ in rows for i, item in items if 5 * len(set(item) & set(t.split())) >= 4 * len(set(item)) - 10 and similarity(item, t.split()) >= 0.8
    }
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), b).collect()
    assert len(want) > 100 and {(r.doc_id, r.item_id) for r in got} == want


def test_least_seeds_is_a_bound_that_copies_reach():
    # nine words, one left out and two added: 0.8, and no three words in a row are left
    item, copy = tuple("abcdefghi"), tuple("ab+cd+fghi")
    assert similarity(item, copy) >= 0.8 and decontamination.align(item, copy)[0] >= 0.8
    kept = set(zip(item, item[1:])) & set(zip(copy, copy[1:]))
    assert 1 <= decontamination.least_seeds(9) <= len(kept)


def test_rare_seeds_leave_no_copy_without_one():
    rng = random.Random(3)
    for m in range(1, 30):
        item = tuple(f"w{rng.randrange(2 * m)}" for _ in range(m))
        grams = decontamination._grams(list(item))
        n_docs = {g: rng.randrange(1, 50) for g in grams}
        seeds = decontamination.rare_seeds([(1, item)], n_docs)
        left_out = [g for g in grams if g not in seeds]
        assert len(left_out) < decontamination.least_seeds(m)  # a copy keeps more than those
        assert not left_out or min(n_docs[g] for g in left_out) >= max(n_docs[g] for g in seeds)
    assert decontamination.rare_seeds([(1, ("a", "b", "c"))], {}) == {}


def test_very_long_item_and_text(spark):
    words = [f"w{i % 997}x{i % 89}" for i in range(3000)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, " ".join([*["filler"] * 40_000, *words[:1500], "new", *words[1500:], *["the end"] * 9]), "x"), (2, " ".join(words[:2000]), "x")]
    got = decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), b).collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in got] == [(1, 40_000, 43_001)]


def test_short_item_that_many_documents_hold(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    rows = [(d, f"so alpha beta gamma delta epsilon it is {d}", "x") for d in range(60)] + [(99, "alpha gamma beta", "x")]
    got = decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), b).collect()
    assert {r.doc_id for r in got} == set(range(60)) and {r.rarest_docs for r in got} == {60}


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_SEEDS", 30)
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    small = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b.limit(6)).collect()}
    monkeypatch.undo()
    assert small == {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b.limit(6)).collect()}


def test_contaminated_query_and_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: " ".join(decontamination.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join(decontamination.words_of(r.text))}
    got = {(r.doc_id, r.item_id) for r in decontamination.op2_benchmark_decontamination(spark, SF).collect()}
    assert want <= got
    kept = decontamination.stage_decontamination(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_stage_tells_rows_of_null_and_repeated_ids_apart(spark):
    bad = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    rows = [(None, f"so {bad} it is", "x"), (None, "clean words without an id", "x"), (5, bad, "x"), (5, "clean words of the same id", "x"), (6, None, "x"), (None, None, "x")]
    kept = decontamination.stage_decontamination(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(((i, t) for i, t, _ in rows if t is None or "clean" in t), key=repr)


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PII_EDGE = [
    (1, None, "x"), (2, "", "x"), (3, "a@b.c@d.e x@y a.b+c@d-e.f.g. @q.r", "x"), (4, "1.2.3.4 256.1.1.1 001.02.3.255.9 1.2.3", "x"),
    (5, "4111 1111-1111 1111 and 4111111111111112 12 34", "x"), (6, "+1 (367) 555-7441 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "x"),
    (7, 'é😀 key me@ex.org token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x"), (7, "password=f0b4e711f4353f8e01 x", "x"), (None, "me@ex.org", "x"),
    (8, "digits 1" * 20_000, "x"), (9, "plain words only, 2024 and version 3", "x"),
]


def test_base_spans_match_brute_force(spark):
    for _, t, _ in PII_EDGE:
        assert pii.base_spans(t or "") == brute_base(t)
    random.seed(6)
    for _ in range(3000):
        t = "".join(random.choice("ab1.@+- ()4%_\n2") for _ in range(40))
        assert pii.base_spans(t) == brute_base(t), t


PLAIN = {
    "iban": r"(?<![A-Z0-9])([A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?)(?![A-Z0-9])",
    "ssn": r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])((?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,})(?![A-Za-z0-9])",
}


def brute_candidates(text):
    taken, out = [(s, e) for _, s, e in brute_base(text)], []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            if all(e <= m.start() or m.end() <= s for s, e in taken):
                out.append((kind, m.start(), m.end()))
                taken.append(m.span())
    return out


def test_candidates_match_brute_force():
    rng = random.Random(9)
    parts = ["DE44 5001 0517 5407 3249 31", "GB29NWBK60161331926819", "123-45-6789", "987-65-4320-1", "AKIA1234567890ABCD", "key=", "/a_b-", "+1 (367) 555-7441", "me@ex.org", "4111 1111 1111 1111", "f0b4e711f4353f8e01", " ", "\n", "x", "-", "1.2.3.4", "Q"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(8))
        assert [c[:3] for c in pii.candidates(t, pii.base_spans(t))] == brute_candidates(t), t


def test_gazetteers():
    votes = lambda kind, span: pii._listed(kind, span)
    assert votes("iban", "DE44 5001 0517 5407 3249 31") == 1 and votes("iban", "DE44 5001 0517") == -1 and votes("iban", "XX44 5001 0517") == -1
    assert votes("ssn", "078-05-1120") == -1 and votes("ssn", "536-90-4399") == 0
    assert votes("secret", "AKIA1Z34567890ABCD") == 1 and votes("secret", "your_api_key_1") == -1 and votes("secret", "f0b4e711f4353f8e01") == 0


def test_long_texts_take_time_in_proportion():
    import time

    long = {
        "digits": "1" * 1_000_000, "dashes": "-" * 1_000_000 + "1", "dotted": "1." * 500_000, "dialled": "+1" + "-" * 1_000_000, "at": "a@" * 500_000,
        "secrets": " ".join(f"password=f0b4e711f4353f8e{i:05d}" for i in range(50_000)),
    }
    for name, t in long.items():
        began = time.process_time()
        pii.candidates(t, pii.base_spans(t))
        assert time.process_time() - began < 10, name  # what isn't linear takes many minutes


def test_find_edges(spark):
    df = spark.createDataFrame(PII_EDGE, SCHEMA).withColumn("base", F.lit(1)).withColumn("spans", F.lit("mine"))
    got = pii.find(df).collect()
    assert len(got) == len(PII_EDGE)
    want = sorted(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(t)).encode()).hexdigest() for _, t, _ in PII_EDGE)
    assert sorted(r.base_sha256 for r in got) == want
    assert pii.find(df.limit(0)).count() == 0


def test_secrets_are_added_and_clean_text_is_left_alone(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in pii.op10_pii(spark, "/root/testdata/sf0.01").collect():
        base = brute_base(docs[r.doc_id])
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert spans[: len(base)] == [[k, str(s), str(e)] for k, s, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in pii.BASE]
        planted = [m.span(1) for m in re.finditer(r'(?:password=|token = ")([0-9a-f]{12,})', docs[r.doc_id])]
        assert [(int(s), int(e)) for _, s, e in spans[len(base) :]] == planted


def test_em_trusts_the_labelers_that_agree():
    def code(*v):
        out = 0
        for x in v:
            out = out * 3 + x + 1
        return out

    counts = {("secret", code(1, 0, 1, 1, 1)): 50.0, ("secret", code(1, 0, -1, -1, -1)): 50.0}
    right, reliable = pii.estimate(counts)
    assert right["secret", code(1, 0, 1, 1, 1)] > 0.9 > 0.1 > right["secret", code(1, 0, -1, -1, -1)]
    assert reliable[0] < reliable[2]
    assert pii.train({}) == {}


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame(PII_EDGE, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    got = pii.stage_pii(spark, df, SF)
    assert got.schema.names == df.columns
    texts = [r.text for r in got.collect()]
    assert "[EMAIL]" in [t for t in texts if t and "é" in t][0] and None in texts
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text)


# --- licences


def test_licences_and_inheritance(spark):
    rows = [
        (1, "a/b/x", "\n Licensed under the MIT License.\nhello"), (2, "a/b/y", "foo"), (3, "a/b/c/z", "bar"), (4, "a/w", ""), (5, None, None),
        (6, "q/LICENSE", "x\nApache License, Version 2.0\n"), (7, "q/r/s/t", "Licence? no"), (8, "q/r/u", "text\nReleased under the MIT License."), (8, "q/r/u", "text\nReleased under the MIT License."),
        (9, "t/1", "Released under the MIT License."), (10, "t/2", "Licensed under CC BY-NC 4.0."), (11, "t/3", "plain " * 40_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("mine"))
    got = {(r.doc_id, r.license, r.how) for r in licenses.scan(df.drop("license")).collect()}
    assert got == {
        (1, "MIT", "own"), (2, "MIT", "inherited"), (3, "MIT", "inherited"), (4, None, "none"), (5, None, "none"), (6, "Apache-2.0", "own"),
        (7, "Apache-2.0", "inherited"), (8, "MIT", "own"), (9, "MIT", "own"), (10, "CC-BY-NC-4.0", "own"), (11, "CC-BY-NC-4.0", "inherited"),
    }
    assert licenses.scan(df.drop("license").limit(0)).count() == 0


def test_headers_that_the_tables_lack(spark):
    headers = {
        "// SPDX-License-Identifier: GPL-3.0": "GPL-3.0", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "SPDX-License-Identifier: CC0-1.0": "CC0-1.0", "SPDX-License-Identifier: CC-BY-4.0": "CC-BY-4.0",
        "SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0", "MIT License": "MIT", "Apache License": "Apache-2.0", "GNU GENERAL PUBLIC LICENSE": "GPL-1.0-or-later",
        "License: MIT": "MIT", "Copyright (c) 2020 Jane Doe. Licensed under the MIT License.": "MIT", "See the license for details": None, "Copyright 2020 MIT": None,
    }
    rows = [(i, f"d{i}/x", h + "\nplain text") for i, h in enumerate(headers)]
    got = {r.doc_id: r.own for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(headers.values())


def brute_passages(text):
    """Of a text in lower case, by plain splitting."""
    def bare(x):
        return "\n".join(re.sub(r"^[\t ]*(?:(?:/?\*+|//+|#+|--+|;+|%+|<!--)(?=[\t\r ]|$))?[\t ]*", "", line) for line in x.split("\n"))

    cut = lambda x: re.split(r"\n[\t\r ]*\n", x)
    out = [bare(text), *cut(bare(text)), *map(bare, cut(text))]
    for line in text.split("\n"):
        out += [line, *re.split(licenses.SENTENCE_END, line)]
    return out


def brute_scorer(texts):
    """(best cosine, license) of a passage, all templates compared, nothing left out."""
    import math

    known = licenses.vocabulary()
    n_with = {t: 0 for t in known}
    for t in texts:
        held = {w.rstrip(".,;:!?\"'()") for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())}
        for k in known:
            n_with[k] += k in held
    idf = licenses.weights(len(texts), n_with)
    rest = math.log(len(texts) + 1) + 1
    size = lambda c: math.sqrt(sum((n * idf.get(t, rest)) ** 2 for t, n in c.items()))
    templates = [(name, c, size(c)) for name, c in licenses.templates()]

    def best(passage):
        """(cosine, terms that templates have, license)"""
        own = {}
        for t in licenses.terms(passage):
            own[t] = own.get(t, 0) + 1
        if not own:
            return 0.0, 0, None
        length = size(own)
        scores = [(round(sum(own.get(t, 0) * n * idf[t] ** 2 for t, n in c.items()) / length / b, 9), name) for name, c, b in templates]
        top = max(s for s, _ in scores)
        return top, sum(n for t, n in own.items() if t in idf), min(name for s, name in scores if s == top)

    return best


def best_of(scores):
    top = max((s[:2] for s in scores), default=(0.0, 0))
    return top[0], min(n for *s, n in scores if tuple(s) == top) if top[0] >= licenses.MATCH else None


def test_licence_scores_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    score = brute_scorer(list(texts.values()))
    seen = {}
    for r in licenses.op5_license_scan(spark, SF).collect():
        scores = [seen[p] if p in seen else seen.setdefault(p, score(p)) for p in set(brute_passages(texts[r.doc_id].lower())) if len(p) < 400]
        top, own = best_of(scores)
        assert r.own == own
        if r.own:
            assert abs(r.cosine - top) < 1e-5


def test_licence_texts_and_files(spark):
    wrap = lambda t, mark="": "\n".join(mark + x for x in __import__("textwrap").wrap(t, 72))
    mit = "\n\n".join(wrap(p) for p in licenses._MIT)
    bsd = lambda keep: "\n\n".join(wrap(p) for k, p in enumerate(licenses._BSD) if k in keep)
    files = {
        f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{mit}": "MIT", mit: "MIT", wrap(licenses._MIT[0]): "MIT",
        f"Copyright 2001 A. B.\n\n{bsd({0, 1, 2, 4})}": "BSD-2-Clause", f"Copyright 2001 A. B.\n\n{bsd(range(5))}": "BSD-3-Clause",
        "\n\n".join(wrap(p, "# ") for p in licenses._APACHE) + "\nimport os\n": "Apache-2.0",
        "/*\n" + wrap(licenses.TEXTS["GPL-3.0"][0], " * ") + "\n */\nint main() {}\n": "GPL-3.0",
        wrap(licenses.TEXTS["GPL-2.0"][1].replace("software:", "software;"), "// "): "GPL-2.0", wrap(licenses.TEXTS["LGPL-2.1"][1]): "LGPL-2.1",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>": "GPL-3.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
        "\n\n".join(wrap(p) for p in licenses._ZLIB): "Zlib", "\n".join(map(wrap, licenses._ISC)): "ISC", wrap(licenses.TEXTS["MPL-2.0"][0], "# "): "MPL-2.0",
        wrap(licenses.TEXTS["Unlicense"][0]): "Unlicense", "a way of life is open to anyone who is free\n\nto use it for any purpose": None,
    }
    others = [(100 + i, f"z{i}/x", f"common prose of the world and of words {i}") for i in range(60)]
    rows = [(i, f"d{i}/LICENSE", t) for i, t in enumerate(files)] + others
    got = {r.doc_id: r.own for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(files))] == list(files.values())


def test_bounds_lose_no_passage(spark):
    """What brute force finds among edited statements, with nothing left unscored, the scan finds."""
    rng = random.Random(4)
    statements = [t for _, t in licenses._statements()]
    texts = []
    for _ in range(250):
        words = rng.choice(statements).split()
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["the", "of", "zebra", "license", "2.0", "plain", "use"]))
        texts.append(" ".join(words[rng.randrange(2) :]))
    score = brute_scorer(texts)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).collect()}
    found = 0
    for i, t in enumerate(texts):
        scores = [score(p) for p in set(brute_passages(t.lower()))]
        top, own = best_of(scores)
        found += own is not None
        assert got[i].own == own, t
    assert 50 < found < 250


def test_inheritance_matches_brute_force(spark):
    rng = random.Random(2)
    says = {"MIT": "Licensed under the MIT License.", "ISC": "Released under the ISC License.", "Apache-2.0": "Apache License, Version 2.0"}
    rows, files = [], []
    for i in range(150):
        path = "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + ("/LICENSE" if rng.random() < 0.2 else f"/f{i}")
        own = rng.choice([None, None, None, *says])
        first = rng.random() < 0.5
        rows.append((i, path, "plain" if own is None else f"{says[own]}\nplain" if first else f"plain\nmore\n{says[own]}"))
        files.append((path.rpartition("/")[0], own, own is not None and (first or path.endswith("LICENSE"))))
    given = {}
    for d in {d for d, _, _ in files}:
        votes = [own for x, own, speaks in files if x == d and speaks]
        if votes:
            given[d] = min(set(votes), key=lambda v: (-votes.count(v), v))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect():
        d, own, _ = files[r.doc_id]
        up = d
        while own is None and up not in given and up:
            up = up.rpartition("/")[0]
        assert (r.own, r.license) == (own, own or given.get(up)), r
        assert r.from_dir == (None if own else up if up in given else None)


# --- chat


def test_pairs_match_sql(spark):
    assert_same(chat_format.op6_chat_formatting(spark, SF), chat_format.ORACLE_SQL["op6_chat_formatting"], SF)


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, None, None), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
        (None, 0, "user", "zz"), (5, 0, "user", "q " * 50_000), (5, 0, "user", "q " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("mine"))
    got = {r.chosen_id: r for r in chat_format.format_pairs(chat_format.pair_neighbours(chat_format.records(df))).collect()}
    assert set(got) == {2, 3, None, 5}
    a = got[2]
    assert (a.rejected_id, a.n_prompt_turns, a.prompt) == (1, 1, "<|user|>\nhi<|end|>\n")
    assert a.chosen == "<|assistant|>\nno<|end|>\n<|unknown|>\n<|end|>\n" and a.chosen_mask == "14:24"
    start, end = map(int, a.chosen_mask.split(":"))
    assert a.chosen[start:end] == "no<|end|>\n"
    for k in (3, None, 5):
        assert got[k].rejected_id is None and got[k].rejected is None and got[k].n_prompt_turns == 0 and got[k].prompt == ""
    none = df.limit(0)
    assert chat_format.format_pairs(chat_format.pair_neighbours(chat_format.records(none))).count() == 0


def test_partners_share_a_first_turn(spark):
    rng = random.Random(1)
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"p{i // 3 if i % 5 else i}" if t == 0 else rng.choice("abc")) for i in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    first = {i: text for i, t, _, text in rows if t == 0}
    got = chat_format.format_pairs(chat_format.pair_neighbours(chat_format.records(df))).collect()
    by: dict[str, int] = {}
    for f in first.values():
        by[f] = by.get(f, 0) + 1
    paired = [r for r in got if r.rejected_id is not None]
    assert all(first[r.chosen_id] == first[r.rejected_id] and r.n_prompt_turns >= 1 for r in paired)
    assert len(paired) == sum(n // 2 for n in by.values()) and len(got) == sum(-(-n // 2) for n in by.values())
    assert sorted(x for r in got for x in (r.chosen_id, r.rejected_id) if x is not None) == list(range(60))


def test_identical_conversations(spark):
    rows = [(i, t, "user" if t == 0 else "assistant", "same") for i in (1, 2) for t in (0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat_format.format_pairs(chat_format.pair_neighbours(chat_format.records(df))).collect()
    assert (r.chosen_id, r.rejected_id, r.n_prompt_turns, r.chosen, r.rejected, r.chosen_mask) == (1, 2, 2, "", "", "")
