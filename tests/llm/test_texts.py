import random
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from meridian.llm import decontam, langid, near_dups, quality
from tests.llm.conftest import prose

# Quality


def brute_repeats(ws, k=5):
    seen = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    covered = {j for i in range(len(ws) - k + 1) if seen[tuple(ws[i : i + k])] > 1 for j in range(i, i + k)}
    best = 0
    for i in range(len(ws)):
        for j in range(i + 1, len(ws)):
            n = 0
            while j + n < len(ws) and ws[i + n] == ws[j + n]:
                n += 1
            best = max(best, n)
    return len(covered), best if best >= k else 0


def brute_maximal(ws, k):
    """Strings of k words or more that occur twice, and longer neither to the left nor to the right at all places."""
    places = defaultdict(list)
    for i in range(len(ws)):
        for j in range(i + k, len(ws) + 1):
            places[tuple(ws[i:j])].append(i)
    out = 0
    for x, at in places.items():
        left = {ws[i - 1] if i else ("begin",) for i in at}
        right = {ws[i + len(x)] if i + len(x) < len(ws) else ("end", i) for i in at}
        out += len(at) > 1 and len(left) > 1 and len(right) > 1
    return out


def test_repeats_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        docs = [[r.choice([b"a", b"b", b"c"][: r.randint(1, 3)]) for _ in range(r.randint(0, 40))] for _ in range(r.randint(1, 6))]
        for words, (n, n_long, n_max, best, spans) in zip(docs, quality.repeats(docs, 5, 9), strict=True):
            assert (n, best) == brute_repeats(words) and n_long == brute_repeats(words, 9)[0] and n_max == brute_maximal(words, 5)
            assert sum(b - a for a, b in spans) == n and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in pairwise(spans))


def test_a_text_of_one_word(spark):
    """The most intervals that a text can have."""
    (n, n_long, n_max, best, spans) = quality.repeats([[b"a"] * 30_000])[0]
    assert (n, n_long, n_max, best, spans) == (30_000, 30_000, 29_995, 29_999, [(0, 30_000)])


def test_quality_rows(messy, empty, messy_rows):
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) for r in quality.judge(messy).collect())
    want = []
    for d, t in messy_rows:
        words = (t or "").encode().split()
        n = brute_repeats(words)[0] if len(words) < 100 else None
        want.append((d or 0, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), n))
    for g, w in zip(got, sorted(want, key=lambda x: x[:4]), strict=True):
        assert g[:4] == w[:4] and (w[4] is None or g[4] == w[4])
    assert quality.judge(empty).count() == 0 and quality.kept_documents(empty).count() == 0


def test_quality_verdicts(spark, messy):
    line = prose(20, 1)
    rows = [(1, prose(50, 2)), (2, f"{line}\n{line}\n\n{line}"), (3, "few words"), (4, prose(400, 3) + " " + line + " " + prose(30, 4) + " " + line), (5, (p := prose(120, 6)) + " " + prose(2000, 7) + " " + p), (6, " ".join([(q := prose(30, 8)), prose(200, 9), q, prose(100, 10)])), (7, " ".join([(q := prose(30, 8)), prose(400, 9), q, prose(200, 10)]))]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(1, 8)] == [True, False, False, True, False, False, True]
    # The limit on what long repeats cover decides where neither the base rule nor the longest repeat does.
    assert not got[6]["base_failed"] and got[6]["n_long_words"] == got[7]["n_long_words"] == 60 and got[6]["longest_repeat"] <= 100
    assert got[2]["n_dup_lines"] == 2 and got[5]["longest_repeat"] >= 120 and not got[5]["base_failed"]
    kept = quality.kept_documents(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in quality.judge(messy).where("kept").collect())


# Near-duplicates


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {d: shingle_set(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for d in ids:
        groups[root(d)].append(d)
    return {d: min(g) for g in groups.values() for d in g}, {d: len(s) for d, s in sets.items()}


def mutated(words, n, r):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    r, rows = random.Random(9), []
    for g in range(6):
        base = prose(150, 100 + g).split()
        rows += [" ".join(base)] * 3 + [mutated(base, r.randint(0, 9), r) for _ in range(40)]
    rows += [prose(80, 500 + i) for i in range(40)] + ["", "one", "one", "One two", None]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [256, 7])
def test_groups_against_brute_force(spark, copies, block, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", block)
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_dups.groups(df, words=3, percent=85).collect()}
    want, sizes = brute_components(copies, 3, 85)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: r["n_shingles"] for d, r in got.items()} == sizes


def test_signature_estimates_similarity():
    a = near_dups.shingles(prose(400, 1), 3)
    b = near_dups.shingles(" ".join(prose(400, 1).split()[:300] + prose(100, 2).split()), 3)
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    same = (near_dups.signature(a, 1024) == near_dups.signature(b, 1024)).mean()
    assert abs(true - same) < 0.06


def test_messy_groups(messy, empty):
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_dups.groups(messy).collect()), key=str)
    assert (10, 3) in got and got.count((3, 3)) == 2 and got.count((None, None)) == 2 and (1, 1) in got and (2, 2) in got and (9, 9) in got
    assert near_dups.groups(empty).count() == 0
    one = near_dups.one_of_each(messy)
    assert one.columns == messy.columns
    assert sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 0, 1, 2, 3, 7, 8, 9, 11, 12]


def test_rows_of_one_doc_id(spark):
    """Each row goes by its own text: none is lost for another row of the same doc_id, copies and repeated rows are."""
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    near = c.split()
    near[40] = "changed"
    rows = [(5, a, 1), (5, b, 2), (3, a, 3), (7, b, 4), (8, c, 5), (8, c, 5), (8, " ".join(near), 6), (9, c, 7), (None, a, 8), (None, a, 8), (4, None, 9), (4, "", 10), (6, None, 11), (6, a, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in near_dups.groups(df).collect())
    assert got == sorted([(5, 76, 3), (5, 76, 5), (3, 76, 3), (7, 76, 5), (8, 76, 8), (8, 76, 8), (8, 76, 8), (9, 76, 8), (0, 76, 0), (0, 76, 0), (4, 0, 4), (4, 0, 4), (6, 0, 6), (6, 76, 3)])
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dups.one_of_each(df).collect())
    assert left == sorted([(5, b), (3, a), (8, c), (8, " ".join(near)), (0, a), (0, a), (4, ""), (6, "")])


def test_salts_and_leftover_tables(spark, copies, monkeypatch):
    """More salts give the same groups, and only the tables that the result reads stay in the shared folder."""
    import os

    from meridian.llm import common

    df = spark.createDataFrame(copies + copies[:30] * 3, "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, near_dups.groups(df, 3, 85).collect()))
    monkeypatch.setattr(near_dups, "SALT_ROWS", 5)
    assert sorted(map(tuple, near_dups.groups(df, 3, 85).collect())) == want
    folder = common.shared_root(spark).removeprefix("file://") + "/meridian"
    before = set(os.listdir(folder))
    near_dups.one_of_each(df, 3, 85).count()
    assert sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before) == ["groups", "several"]


# Decontamination

ITEMS = [(i, prose(30 + i, 900 + i).capitalize() + ". " + prose(10, 950 + i) + ".") for i in range(12)] + [(50, None), (51, ""), (52, prose(300, 990)), (53, "Short one.")]


def word_pairs(words):
    return set(pairwise(words)) if len(words) > 1 else set(words)


def brute_matches(rows, items, threshold=decontam.THRESHOLD):
    """Every passage scored against every item without any index."""
    words = {i: decontam.terms(t) for i, t in items if t}
    words = {i: w for i, w in words.items() if w}
    df = Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / len(words)
    import math

    def impact(i):
        c = Counter(words[i])
        norm = 1.2 * (0.25 + 0.75 * len(words[i]) / mean)
        return {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + norm) for t, f in c.items()}

    out = set()
    for d, t in rows:
        ws = decontam.terms(t or "")
        for i, w in words.items():
            half = max(64, 1 << (len(w) - 1).bit_length())
            im = impact(i)
            for at in range(0, max(len(ws) - half, 1), half):
                p = ws[at : at + 2 * half]
                have = set(pairwise(p)) | set(p)
                q, a = (word_pairs(x) for x in decontam.question_answer(dict(items)[i]))
                share = [len(x & have) / len(x) if x else 1.0 for x in (q, a)]
                if p and sum(im.get(x, 0) for x in set(p)) >= threshold * sum(im.values()) and min(share) >= 0.5:
                    out.add((d, i))
    return out


def test_decontam_against_brute_force(spark, messy, empty):
    r, rows = random.Random(5), []
    for n in range(60):
        text = prose(r.randint(20, 400), 2000 + n).split()
        if n % 2:
            item = ITEMS[r.choice([*range(12), 14])][1].split()
            if n % 4 == 1:
                for _ in range(len(item) // 3):
                    item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(text))
            text[at:at] = item
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench).collect()}
    assert got == brute_matches(rows, ITEMS) and len(got) > 15
    hit = {d for d, _ in got}
    assert {x["doc_id"] for x in decontam.clean_documents(docs, bench).collect()} == {d for d, _ in rows} - hit
    assert decontam.contaminated(messy, bench).count() == 0 and decontam.clean_documents(messy, bench).columns == messy.columns
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.clean_documents(docs, bench.limit(0)).count() == len(rows)


def test_a_large_benchmark_takes_more_passes(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontam, "PART_BYTES", 600)
    assert sorted(i for p in decontam.parts(bench) for i, _ in p) == sorted(i for i, t in ITEMS if t is not None)


def test_parts_of_a_benchmark_match_as_the_whole(spark, monkeypatch):
    r = random.Random(8)
    items = [*ITEMS, (3, prose(33, 77)), (None, prose(35, 78)), (None, prose(35, 79))]
    rows = []
    for n in range(120):
        item = r.choice([t for _, t in items if t and len(t) > 50]).split()
        for _ in range(r.randint(0, len(item) * 2 // 3)):
            item[r.randrange(len(item))] = "changed"
        rows.append((n, " ".join(prose(r.randint(0, 90), 3000 + n).split() + item)))
    rows += [(500, items[3][1] + " " + prose(33, 77))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(repr, decontam.contaminated(docs, bench, 0.4, 0.2, 0.2).collect()))
    kept = sorted(x["doc_id"] for x in decontam.clean_documents(docs, bench).collect())
    monkeypatch.setattr(decontam, "PART_BYTES", 900)
    assert decontam._dealt(bench)[1] > 5 and len(one) > 60
    assert sorted(map(repr, decontam.contaminated(docs, bench, 0.4, 0.2, 0.2).collect())) == one
    assert sorted(x["doc_id"] for x in decontam.clean_documents(docs, bench).collect()) == kept


def test_index_files_and_blocks(tmp_path):
    """Every passage and item of random texts, scored one by one, against lists read back from a file."""
    r = random.Random(4)
    items = [(None if i == 7 else i, prose(r.randint(1, 200), 40 + i)) for i in range(60)]
    index = decontam.build(items)
    path = f"file://{tmp_path}/a/index.npz"
    index.save(path)
    index = decontam.Index.load(path)
    docs = [decontam.terms(" ".join([prose(r.randint(0, 300), 700 + n), items[n][1], prose(r.randint(0, 300), 800 + n)])) for n in range(40)] + [[]]
    got = {(d, x, v[3]) for d, m in enumerate(decontam.matches(index, docs, 0.5, 0.0, 0.0)) for x, v in m.items()}
    best = {}
    for l in index.lists:
        for j, n in enumerate(l.items.tolist()):
            impact = {}
            for t in range(len(l.term_max)):
                for e in range(l.starts[t], l.starts[t + 1]):
                    for q in range(l.first[e], l.first[e + 1]):
                        assert l.blocks[e] == l.postings[q] // decontam.BLOCK_ITEMS and l.impacts[q] <= l.block_max[e] <= l.term_max[t]
                        if l.postings[q] == j:
                            impact[t] = float(l.impacts[q])
            assert abs(sum(impact.values()) - 1) < 1e-5
            for d, ws in enumerate(docs):
                for at in range(0, max(len(ws) - l.half, 1), l.half):
                    score = sum(impact.get(index.vocab.get(w), 0.0) for w in set(ws[at : at + 2 * l.half]))
                    key = (d, index.item_ids[n])
                    if score >= 0.5 - 1e-5 and ((score, -at) > best.get(key, (0, 0))):
                        best[key] = (score, -at)
    assert {(d, i) for d, i, _ in got} == set(best) and len(best) > 60
    assert sum((d, i, -best[d, i][1]) in got for d, i in best) >= 0.95 * len(best)  # ties in the last digit may choose another passage


# Language


def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    assert sorted(model) == ["de", "en", "es", "fr"] and all(0 < len(d) <= langid.DICTIONARY_BYTES for d in model.values())
    held = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.is_held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? _"), (None, "hello thing"), (5, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] for i in (1, 2, 3)) and got[5]["lang_pred"] in model
    assert langid.predict(empty, model).count() == 0
    assert langid.fit(docs.limit(0)) == {} and langid.predict(rows, {}).where("lang_pred <> 'und'").count() == 0


def test_dictionaries_are_taken_from_whole_texts(spark):
    body = {n: prose(4000, n) for n in range(10)}
    rows = [(n, "common header " * 300 + body[n] + f" tail{n}", "en") for n in range(10)] + [(n, "é" * 900 + "ü" * 900, "de") for n in range(10, 300)] + [(500, "short", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    en = model["en"].decode()
    assert 0.95 * langid.DICTIONARY_BYTES <= len(model["en"]) <= langid.DICTIONARY_BYTES and en.count("header") * 14 < len(en) / 3
    for n, t in body.items():
        words = t.lower().split()
        assert all(sum(" ".join(words[i : i + 6]) in en for i in range(at, at + 1000)) > 50 for at in (0, 1000, 2000, 2990))
    assert model["fr"] == b"short" and abs(model["de"].count("é".encode()) - model["de"].count("ü".encode())) < len(model["de"]) / 8
