"""Each operator against brute force, round trips or held-out rows, and on odd tables."""

import base64
import dataclasses
import hashlib
import random
import re
import re._constants as sre
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import Row
from pyspark.sql import functions as F

from equispark.llm import binary_tokens, decontamination, fingerprints, language, license_rules, licenses, neardup, packing, pii, quality, queries, url_filter
from equispark.llm.tagger import Tagger
from equispark.llm.tokens import Encoder, vocabulary

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.SQL[name]) == ""


def test_url_filter_on_odd_rows(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://net"), (3, None), (4, "no scheme/fr/"), (5, "x://fr.org/fr/#"), (5, "x://fr.org/fr/#"), (6, "ftp://q.w/listed?")]
    pages = spark.createDataFrame(rows, "page_id int, url string").withColumn("key", F.lit(1))
    out = url_filter.filtered(pages, queries.URL_RULES, spark.createDataFrame([("q.w/listed",)], "key string"))
    got = sorted(tuple(r)[:5] for r in out.collect())
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "net", "", None, "allow"),
        (3, "", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "fr.org", "/fr/", "org/fr/", "allow"),
        (5, "fr.org", "/fr/", "org/fr/", "allow"),
        (6, "q.w", "/listed", None, "block"),
    ]
    assert url_filter.filtered(pages.limit(0), queries.URL_RULES, spark.createDataFrame([], "key string")).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build(universe)
    assert len(cascade.levels) > 2
    assert universe.filter(cascade.listed(F.col("key")) != F.col("listed")).count() == 0


def brute_licenses(text):
    words, at, labels = WORDS.findall(lowered(text)), [], set()
    for phrase, label in queries.BASE_PHRASES.items():
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, documents):
    known = texts(spark)
    for r in queries.op2_licenses(spark, SMALL).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(known[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.license_scan(documents, queries.BASE_PHRASES).count() == documents.count()


def test_license_rules_suppress_by_priority_and_containment():
    assert len(licenses.rules()) > 200
    found = licenses.scan(b"SPDX-License-Identifier: MIT. Licensed under the Apache License, Version 2.0", {})
    assert found[5] == ["apache-2.0", "mit"] and found[6] == 1.0
    assert len(licenses.detections(b"gpl " * 20_000)) == 20_000


def examples(parsed):
    """A text for each way through the alternatives and options of a parsed pattern."""
    out = [""]
    for op, value in parsed:
        if op is sre.LITERAL:
            own = [chr(value)]
        elif op is sre.ANY:
            own = ["x"]
        elif op is sre.IN:
            own = [chr(v if o is sre.LITERAL else v[0]) for o, v in value]
        elif op is sre.BRANCH:
            own = [e for branch in value[1] for e in examples(branch)]
        elif op is sre.SUBPATTERN:
            own = examples(value[3])
        else:
            assert op in (sre.MAX_REPEAT, sre.MIN_REPEAT), op
            own = [e * n for n in sorted({value[0], max(value[0], 1)}) for e in examples(value[2])]
        out = [a + b for a in out for b in own]
    return out


def test_license_gates_stand_in_every_alternative(monkeypatch):
    phrases = [line.split(" | ", 3)[3].strip() for line in license_rules.RULES.strip().splitlines()]
    made = {p: [re.sub(" +", " ", e).strip() + " ." for e in examples(re._parser.parse(p))] for p in phrases}
    by_pattern = {licenses.phrase_pattern(p).pattern: p for p in phrases}
    seen, gated = 0, {}
    for rule in licenses.rules():
        for text in made.get(by_pattern.get(rule.pattern.pattern), []):
            assert rule.pattern.search(text.encode()), (rule.label, text)
            assert all(gate in text.encode() for gate in rule.gates), (rule.label, rule.gates, text)
            gated[text] = licenses.detections(text.encode())
            seen += 1
    assert seen > 600
    open_rules = tuple(dataclasses.replace(r, gates=()) for r in licenses.rules())
    monkeypatch.setattr(licenses, "rules", lambda: open_rules)
    place = lambda found: [(a, b, r.label) for a, b, r in found]
    assert all(place(licenses.detections(text.encode())) == place(found) for text, found in gated.items())


@pytest.mark.parametrize("text, label", [(f"This document may not be {w}", "proprietary") for w in ("reproduced", "copied", "distributed", "republished")] + [("PNG Reference Library License", "libpng"), ("University of Illinois Open Source License", "ncsa"), ("University of Illinois/NCSA Open Source License", "ncsa")])
def test_license_labels_need_no_other_words(text, label):
    assert label in licenses.scan(text.encode(), {})[5]
    assert "ncsa" not in licenses.scan(b"ncsa mosaic, under an open source license", {})[5]


def test_quality_held_out(spark, documents):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    aside = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    evidence = quality.fit(docs, labels.filter(~aside))
    out = quality.classify(docs, evidence, F.col("source"), F.col("lang")).join(labels.filter(aside), "doc_id")
    right = out.agg(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.85
    odd = quality.classify(documents, evidence, F.col("source"), F.col("lang"))
    assert odd.count() == documents.count()
    assert quality.classify(documents.limit(0), evidence, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_follow_the_prior(spark):
    rows = [(i, "good", "big") for i in range(200)] + [(900, "bad", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    even = quality.Evidence(np.zeros(quality.SIZE), 0.0, 0.0)
    out = {r.doc_id: r for r in quality.classify(docs, even, F.col("source"), F.lit(None)).collect()}
    assert abs(out[900].path_posterior - 0.5) < 1e-6 and abs(out[1].score - 0.5) < 1e-6


def test_language_held_out(spark, documents):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").filter("held_out")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert out.join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = {r.doc_id: r for r in language.identify(documents).collect()}
    assert odd[4].lang_pred == odd[5].lang_pred == "und" and odd[4].score == 0
    assert odd[8].lang_pred in ("en", "de") and len(odd) == 10
    assert language.identify(documents.limit(0)).count() == 0


def test_language_rejects_noise_and_unlearnt_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model, draw = language.fit(docs.filter(~language.held_out(F.col("doc_id")))), np.random.default_rng(3)
    pick = lambda signs, n: "".join(draw.choice(list(signs), n))
    noise = [" ".join(pick("bcdfghjklmnpqrstvwxz", 7) for _ in range(n)) for n in (10, 60, 900)]
    noise += [base64.b64encode(draw.bytes(n)).decode() for n in (60, 600, 6000)] + [pick("abcdefghijklmnopqrstuvwxyz ", 500)]
    noise += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto"]
    noise += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem"]
    judged = lambda found: model.judge(found, language.gram_counts(found))[2]
    assert judged(noise) == [True] * len(noise)
    clean = [r.text for r in docs.filter(language.held_out(F.col("doc_id"))).collect() if any(c.isalpha() for c in r.text)]
    assert np.mean([judged([t])[0] for t in clean]) < 0.005
    short = [" ".join(t.split()[a : a + 4]) for t in clean[:150] for a in range(0, min(len(t.split()) - 4, 40), 8)]
    short = [t for t in short if t.replace(" ", "").replace(".", "").replace(",", "").isalpha()]
    assert len(short) > 300 and np.mean([judged([t])[0] for t in short]) < 0.01


def test_contamination_on_odd_rows(spark, documents):
    items = spark.createDataFrame([(1, "One, TWO"), (1, "One, TWO"), (2, None), (3, ""), (4, " ".join(f"W{i}" for i in range(20, 31)))], "item_id long, text string")
    out = {r.doc_id: r for r in decontamination.contamination(documents, items).collect()}
    assert (out[6].n_hit, out[6].items, out[7].items) == (2, [1], [1])
    assert (out[1].n_words, out[1].n_hit, out[1].items) == (60, 11, [4])
    text = " ".join(f"w{i}" for i in range(60))
    assert text[out[1].spans[0].start : out[1].spans[0].end].split()[0] == "w20"
    assert not out[4].contaminated and out[4].n_words == 0
    assert decontamination.contamination(documents, items.limit(0)).filter("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontamination.scanner(items, max_bytes=3)


@pytest.mark.parametrize("kind, ids", [("long", [-1, 0, None]), ("string", ["q1", "", None])])
def test_item_ids_of_any_kind(spark, documents, kind, ids):
    items = spark.createDataFrame([(ids[0], "one two"), (ids[1], "ONE TWO"), (ids[2], "two")], f"item_id {kind}, text string")
    out = {r.doc_id: r for r in decontamination.contamination(documents, items).collect()}
    assert (out[6].n_hit, set(out[6].items)) == (2, set(ids[:2]))


def test_several_automata_find_what_one_finds(spark):
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    documents = [(i % 50, some(rng.randrange(40)).upper()) for i in range(60)] + [(None, some(9)), (61, None)]
    items = [(i, some(rng.randrange(1, 9))) for i in range(12)] + [(90, some(30)), (90, some(30)), (None, some(4)), (91, "e e e"), (92, "")]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontamination.parted(benchmark, 4)) == 1 and len(decontamination.parted(benchmark, 4, 10)) > 4
    one, many = (sorted(map(repr, decontamination.contamination(frame, benchmark, 4, most).collect())) for most in (1000, 10))
    assert one == many
    windows = {}
    for item, text in items:
        words = text.split()
        for at in range(max(len(words) - 4, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[at : at + 4]), set()).add(item)
    expected = []
    for doc_id, text in documents:
        words, hit, found = (text or "").lower().split(), set(), set()
        for window, own in windows.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    found |= own - {None}
        expected.append((doc_id, len(words), len(hit), sorted(found)))
    found = decontamination.contamination(frame, benchmark, 4, 10).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.items)) for r in found) == sorted(map(repr, expected))
    kept = decontamination.clean(frame, benchmark, 4, 10).collect()
    assert sorted(map(repr, kept)) == sorted(repr(Row(doc_id=d, text=t)) for (d, t), e in zip(documents, expected) if e[2] == 0)


def test_fingerprints_on_odd_rows(spark, documents):
    out = fingerprints.edits(documents, 3).collect()
    assert len(out) == documents.count()
    prints = {r.doc_id: r.fingerprint for r in out}
    assert prints[4] == prints[5] and prints[1] != prints[3]
    one = fingerprints.edits(documents.filter("doc_id = 1"), 3).first()
    assert one.near_next == 1.0 and 0.4 < one.near_edited < 1
    assert fingerprints.edits(documents.limit(0)).count() == 0
    a, b = (fingerprints.fingerprint(fingerprints.tree(F.lit(t))) for t in ("p\nq\n\nr\ns", "p\nq\n\nr\nt"))
    assert [tuple(x) for x in spark.range(1).select(fingerprints.changed_paragraphs(a, b)).first()[0]] == [(1, 1)]


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_components(rows):
    sets = [(k, shingle_set(t)) for k, t in rows]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, len(s), least.get(root(i))) for i, (k, s) in enumerate(sets))


def test_near_duplicates(spark, documents):
    for table in (documents, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        out = neardup.near_duplicates(table).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert neardup.near_duplicates(documents.limit(0)).count() == 0


def test_near_duplicates_of_halves(spark):
    """Texts that share about half with each other meet in buckets but are not linked, some are."""
    draw = np.random.default_rng(3)
    lines = [" ".join(f"l{i}x{j}" for j in range(9)) for i in range(30)]
    rows = [(i, " ".join(lines[j] for j in sorted(draw.choice(30, 26, replace=False)))) for i in range(120)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows)


def test_one_row_of_each_component_stays(spark, documents):
    """Rows that share an id, or have none, are judged by their own texts; equal rows leave one."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(3, text["a"]), (5, text["a"] + " end"), (5, text["b"]), (None, text["c"]), (None, text["a"]), (7, text["d"]), (7, text["d"]), (8, None), (8, None), (9, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).withColumn("digest", F.lit(2))
    out = neardup.deduplicated(table)
    assert out.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows) - Counter([(5, text["a"] + " end"), (None, text["a"]), (7, text["d"])])
    kept = [r.doc_id for r in neardup.deduplicated(documents).collect()]
    assert sorted(kept, key=str) == [1, 4, 5, 6, 8, 9, None]
    assert neardup.deduplicated(table.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "a binary, b binary")
    out = neardup.components(links).collect()
    assert len(out) == 41 and {bytes(r.component) for r in out} == {b"\x00"}


def encoded(text):
    from tokenizers import Tokenizer

    return np.asarray([*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_is_the_library(documents):
    rows = [r.text or "" for r in documents.collect()] + ["a  b", "a \n b\n\nc  ", "U.S.A. λabc a_b", " ", "x \n", "12,5 a1'll", "<|endoftext|> x\n\n<|endoftext|>"]
    assert Encoder(vocabulary()).encode(rows) == [encoded(t)[:-1].tobytes() for t in rows]


def test_binary_round_trip(spark, documents, tmp_path):
    binary_tokens.write_tokens(documents, str(tmp_path / "t"), vocabulary(), shards=3)
    out = binary_tokens.read_tokens(spark, str(tmp_path / "t")).collect()
    want = Counter((r.doc_id, encoded(r.text).tobytes()) for r in documents.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id or 0 for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids)
    binary_tokens.write_tokens(documents.limit(0), str(tmp_path / "e"), vocabulary())
    assert binary_tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("bits", [1, 2])
def test_pack_unpack(bits):
    ranks = np.random.default_rng(1).integers(0, 1 << (16 if bits == 1 else 32), 1001, np.uint32)
    control, data = binary_tokens.pack(ranks, bits)
    got = binary_tokens.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), 1001, bits)
    assert (got == ranks).all()


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_personal_data(spark, documents):
    known = texts(spark)
    for r in queries.op9_personal_data(spark, SMALL).collect():
        base = brute_base(known[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(documents).filter(F.size("spans") > 0).count() == 0
    assert pii.personal_data(documents.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a@b@c.d e.f@g.h.i@j.k", "1.2.3.4.5.6.7.8 001.2.3.255 1.2.3.256", "4111 1111-1111 1111 4111111111111112", "+1 (234) 567-89.0) +12 +", "é中 x+y@ä.b z@q.r1"])
def test_base_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_tagger_learns_from_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.fit(docs.filter("doc_id % 2 = 0"))
    found = right = wanted = 0
    for r in docs.filter("doc_id % 2 = 1 AND text RLIKE '[0-9@]'").limit(300).collect():
        starts = pii.window_starts(r.text)
        got = set(pii.reconciled(r.text, starts, tagger.decode(pii.window_codes(r.text, starts))))
        base = set(pii.apart(pii.base_spans(r.text)))
        found, right, wanted = found + len(got), right + len(got & base), wanted + len(base)
    assert right / wanted > 0.9


def test_tagger_adds_what_no_pattern_matches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.fit(docs.filter("doc_id % 2 = 0"))
    clean = [r.text for r in docs.filter("doc_id % 2 = 1 AND text RLIKE '[0-9@]'").limit(300).collect() if not pii.base_spans(r.text) and "+" not in r.text]
    clean += ["On 2023-04-05 at 12:30 the 3 of 17 rows, 1,234,567.89 in all, were v2.10.3.", "Order 12345678 of page 12-14, @someone, 978-3-16-148410-0 and 0x1f3a9b2c here."]
    assert len(clean) > 20 and not any(pii.spans_in(clean, tagger))
    planted = [("phone", "(407) 555-7710"), ("phone", "407-555-7710"), ("phone", "(612) 555-0139"), ("phone", "312-555-0188"), ("ip", "10[.]20[.]30[.]40"), ("email", "jo (at) mail7 (dot) example (dot) com")]
    around = [("the thonble. Shre hewhha ", " reths ononti and of"), ("Der und schach von ", ", tet zau gest"), ("eaux mentez que ", ".\nEn elle pour les")]
    for kind, token in planted:
        texts = [a + token + b for a, b in around]
        assert not any(pii.base_spans(t) for t in texts)
        found = pii.spans_in(texts, tagger)
        assert sum((kind, len(a), len(a) + len(token), False) in own for (a, _), own in zip(around, found)) >= 2, (token, found)
    spans = pii.beyond("a (407) 555-7710 x@y.de", [("phone", 2, 23)], [("email", 17, 23, True)])
    assert spans == [("phone", 2, 16)]


def test_tagger_gradients():
    tagger, draw = Tagger(5), np.random.default_rng(0)
    x, y = draw.integers(0, 100, (7, 3)), draw.integers(0, 5, (7, 3))
    _, grads = tagger.gradients(x, y)
    for name, at in (("hf", (1, 2)), ("xb", (0, 3)), ("step", (1, 1)), ("out", (2, 1)), ("first", (0,))):
        kept, values = tagger.p[name].copy(), []
        for move in (1e-2, -1e-2):
            tagger.p[name] = kept.copy()
            tagger.p[name][at] += move
            values.append(tagger.gradients(x, y)[0])
        tagger.p[name] = kept
        assert abs((values[0] - values[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_packing(spark, documents):
    for table in (documents, spark.read.parquet(f"{SMALL}/documents.parquet")):
        out = packing.pack(table, vocabulary(), group_rows=64).collect()
        want = Counter((r.doc_id, zlib.crc32(encoded(r.text).tobytes())) for r in table.collect())
        by_doc, places = {}, {}
        for r in out:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            by_doc.setdefault(r.doc_id, []).append(r)
            assert r.length * 4 == len(r.ids)
        for k, own in by_doc.items():
            if sum(n for (d, _), n in want.items() if d == k) == 1:
                own.sort(key=lambda r: r.piece)
                assert want[(k, zlib.crc32(b"".join(bytes(r.ids) for r in own)))] == 1
                assert all(r.length == 2048 for r in own[1:]) and own[0].start == 0
        for spots in places.values():
            spots.sort()
            assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and sum(spots[-1]) <= 2048
    assert packing.pack(documents.limit(0), vocabulary()).count() == 0


def test_sum_of_squares_prefers_the_least_sum():
    state = packing.SumOfSquares(10)
    assert [state.place(n) for n in (6, 6, 4, 4, 10)] == [(0, 0), (1, 0), (1, 6), (0, 6), (2, 0)]
