"""The corpus operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimcheck.llm import chat, decontaminate, html_text, jaccard_join, labelled_urls, licenses, line_dedup, mixing, quality, queries, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def copies(seed: int = 5) -> list[tuple]:
    """Documents with exact and near copies, shared passages, nulls, empty and long texts, repeated ids and rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    base = [[word() for _ in range(n)] for n in (3, 30, 60, 60, 200)]
    passage = " ".join(word() for _ in range(60))
    rows = []
    for k in range(160):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 2, 6, 20))):
            words[rnd.randrange(len(words))] = word()
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        if k % 5 == 0:
            lines.insert(rnd.randrange(len(lines) + 1), passage)
        rows.append((k, "\n".join(lines), "en", rnd.choice(["a", "b", None]), 0))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", "en", "a", 3), (203, "b " * 30_000, "en", "b", 1), (3, rows[3][1], "en", "a", 1), (4, "other text with the same id", "en", "a", 1)]
    return [*rows, rows[7], (None, rows[8][1], "en", "a", 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(copies(), DOCS).withColumns({"size": F.lit("x"), "kept": F.lit(1), "n_words": F.lit(None).cast("string"), "print": F.lit(2), "node": F.lit(3), "target": F.lit("t")}).persist()


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    name = lambda i: min((x for x in least[root(i)] if x is not None), default=None)
    return sorted(((r[0], len(sets[i]), name(i) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("short_list", [2, 32])
def test_jaccard_join_equals_all_pairs(spark, docs, monkeypatch, short_list):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str) == brute_components(copies())


def test_jaccard_join_in_turns_equals_all_pairs(spark, docs, monkeypatch):
    """Sets that meet in many turns give the same groups; what one turn sends is a part."""
    sent, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "TURN", 8)
    monkeypatch.setattr(jaccard_join, "LIST_TURNS", 1)
    monkeypatch.setattr(jaccard_join, "_links", lambda docs, nodes, some, how: sent.append(some.count()) or links(docs, nodes, some, how))
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str) == brute_components(copies())
    assert len(sent) > 2 and max(sent) < sum(sent)


def test_sets_are_sent_once_for_many_partners(spark, monkeypatch):
    """Of 20 groups of 12 near copies, with 66 pairs each, a set goes to its group and not to each of its 11 partners."""
    sent, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda docs, nodes, some, how: sent.append(some.count()) or links(docs, nodes, some, how))
    rows = [(12 * g + k, " ".join(f"g{g}w{i}" for i in range(80)) + f" end{g}of{k}") for g in range(20) for k in range(12)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i // 12 * 12) for i in range(240)]
    assert 240 <= sum(sent) <= 2 * 240


def test_shingles_common_to_many_runs_stand_back(monkeypatch):
    """A shingle that comes once in each run is counted over all of them, by the upper bits of its hash."""
    import numpy as np
    import pyarrow as pa

    texts = [f"shared line of five words own{k} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k} k{k}" for k in range(3 * jaccard_join.COMMON)] + [None, "", "x"]
    monkeypatch.setattr(jaccard_join, "RUN", 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(range(len(texts)), pa.int64())], ["doc_id", "text", "print"])
    out = pa.Table.from_batches(list(jaccard_join._count(iter([batch]), 5)))
    assert out.column("token").null_count == len(out)  # no run sees a shingle twice
    runs = sorted((r for r in out.select(["range", "of_middle", "low"]).to_pylist() if r["range"] is not None), key=lambda r: r["range"])
    pieces = [pa.RecordBatch.from_pylist(runs[k : k + 7], pa.schema([("range", pa.int32()), ("of_middle", pa.binary()), ("low", pa.binary())])) for k in range(0, len(runs), 7)]
    common = np.zeros((jaccard_join.RANGES, (1 << 32) // jaccard_join.RANGES // jaccard_join.FOLD // 8), np.uint8)
    for part in pa.Table.from_batches(list(jaccard_join._common(iter(pieces)))).to_pylist():
        common[part["range"]] = np.frombuffer(part["bits"], np.uint8)
    shared = jaccard_join.shingle_set("shared line of five words", 5, jaccard_join._WordHashes())
    place = int(shared[0] >> np.uint64(32)) // jaccard_join.FOLD
    assert np.bitwise_count(common).sum() == 1 and common.ravel()[place >> 3] >> (place & 7) & 1
    none = np.empty(0, np.int64)
    sets = pa.Table.from_batches(list(jaccard_join._prefixes(iter([batch]), jaccard_join.Similarity(), none, none, common.ravel())))
    assert len(sets) == len(texts) - 2 and not [r for r in sets.column("rare").to_pylist()[:-1] if int(shared.view(np.int64)[0]) in r]


def test_one_of_each_group_stays(spark, docs):
    want = collections.Counter(c for _, n, c in brute_components(copies()) if n)
    left = jaccard_join.one_of_each_group(docs).collect()
    # the two texts of id 4 are two groups that have one name
    assert len([r for r in left if shingles(r.text)]) == len(want) + 1
    assert {r.doc_id for r in left if shingles(r.text)} == set(want)
    assert len([r for r in left if not shingles(r.text)]) == 4


def test_derived_overlaps_equal_counted_ones():
    import numpy as np

    rnd = random.Random(1)
    base = rnd.sample(range(500), 60)
    sets = sorted((np.unique([x if rnd.random() > 0.15 else rnd.randrange(500) for x in base]) for _ in range(60)), key=len)
    group = lambda links: {frozenset(x) for x in _groups(len(sets), links)}
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert pairs and group(jaccard_join.overlap_links(sets, 75)) == group(pairs)


def _groups(n: int, links: list[tuple[int, int]]) -> list[set]:
    groups = [{i} for i in range(n)]
    for a, b in links:
        x, y = next(g for g in groups if a in g), next(g for g in groups if b in g)
        if x is not y:
            groups.remove(y)
            x |= y
    return groups


def test_patience_keeps_order_and_equality():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randrange(25))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_line_dedup_leaves_no_long_common_run(spark, docs):
    """No later document keeps a run of lines of 50 words that an earlier one had; what is deleted was in an earlier one."""
    rows = copies()
    got = {(r.doc_id, r.before): r for r in line_dedup.line_dedup(docs.withColumn("before", F.col("text"))).collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows})
    texts = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            texts.setdefault(doc_id, set()).add(text or "")
    hit = 0
    for (doc_id, before), r in got.items():
        if doc_id is None or before is None:
            assert r.text == before and r.n_deleted == 0
            continue
        lines, left = before.split("\n"), (r.text or "").split("\n")
        n = [len(x.encode().split()) for x in lines]
        earlier = [t.split("\n") for k, ts in texts.items() if k < doc_id for t in ts]
        covered = set()
        for start, end in enumerate(line_dedup.block_ends(n, 50)):
            run = lines[start:end]
            if end and n[start] and any(run == e[k : k + len(run)] for e in earlier for k in range(len(e))):
                covered.update(range(start, end))
        hit += bool(covered)
        assert r.n_deleted >= len(covered) and (r.n_deleted == 0) == (not covered)
        assert r.n_deleted == len(lines) - len(left) or r.text == ""
        pool = {x for e in earlier for x in e}
        assert not (collections.Counter(lines) - collections.Counter(left)).keys() - pool
    assert hit > 20


def test_warc_round_trip_with_dictionary(spark, tmp_path):
    rows = [(k, f"https://x.org/{k}", f"<html><nav>menu of the site</nav><p>page {k % 40}</p>" + "<p>text that all pages share</p>" * 8) for k in range(400)]
    rows += [(900, None, None), (901, "u", ""), (902, "a\nb: c", "short"), (903, "v", "short"), (None, "w", rows[1][2]), (1, "again", rows[1][2]), (904, "big", "é" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))
    folder = f"file://{tmp_path}/warc"
    got = warc.archive_round_trip(pages.repartition(3), folder).collect()
    assert len(got) == len(rows)
    least = {}
    for page_id, _, text in rows:
        if page_id is not None and len((text or "").encode()) >= 100:
            least[text] = min(page_id, least.get(text, page_id))
    want = []
    for page_id, _, text in rows:
        payload = (text or "").encode()
        to = least.get(text)
        revisit = to is not None and (page_id is None or page_id > to)
        want.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    archives = list((tmp_path / "warc").glob("*.warc.zst"))
    assert any(a.read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little") for a in archives)
    assert sum(len(list(warc.unpack(a.read_bytes()))) for a in archives) == len(rows)


def test_warc_of_no_pages(spark, tmp_path):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none").count() == 0


def test_url_rules_and_model(spark):
    rows = [(1, "HTTP://A.NET/x"), (2, "http://b.example.net/en/1?q"), (3, "http://example.net.org/fr/"), (4, "http://a.net"), (5, None), (6, "no scheme"), (7, "x://Example.COM/de/a#b"), (8, "http://notexample.com/de/")]
    labelled = spark.createDataFrame([("good%d.org" % k, f"/read/{k}", False) for k in range(40)] + [("casino%d.biz" % k, f"/win/{k}", True) for k in range(40)], "host string, path string, blocked boolean")
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES, labelled).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(1, 9)] == [
        ("a.net", "/x", "net/"), ("b.example.net", "/en/1", "example.net/en/"), ("example.net.org", "/fr/", "org/fr/"), ("a.net", "", None), ("", "", None), ("", "", None),
        ("example.com", "/de/a", "example.com/de/"), ("notexample.com", "/de/", None),
    ]
    assert [got[k].verdict for k in (1, 2, 3, 7)] == ["block", "allow", "allow", "block"]
    fresh = spark.createDataFrame([(k, f"http://casino{k}.biz/win/{k}") for k in range(50, 70)] + [(k, f"http://good{k}.org/read/{k}") for k in range(150, 170)], "page_id long, url string")
    right = [r.verdict == ("block" if r.page_id < 100 else "allow") for r in url_filter.judge_urls(fresh, {}, labelled).collect()]
    assert sum(right) >= 38
    empty = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), {}).collect()
    assert empty[0].p_block == 0.5 and empty[0].verdict == "block"


def test_url_query_blocks_bad_hosts_that_no_rule_names(spark, tmp_path):
    names = {True: ["casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x"], False: ["ththan", "tionble", "therly", "broads-authority", "alphabeta", "pillows", "running-track", "farm-shop", "essex-police", "adult-school", "github"]}
    table_hosts = {host for host, _, _ in labelled_urls.labelled_urls()}
    urls = [(bad, f"https://{prefix}{name}.example.com/{lang}/{k}") for bad in names for name in names[bad] for prefix in ("", "m.", "www.") for k, lang in enumerate(("en", "fr", "es"))]
    assert not any(f"{name}." in host for name in names[True] for host in table_hosts)
    spark.createDataFrame([(k, url) for k, (_, url) in enumerate(urls)], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op2_url_filter"](spark, str(tmp_path)).collect()}
    assert all(r.rule is None for r in got.values())
    assert [urls[k] for k in sorted(got) if (got[k].verdict == "block") != urls[k][0]] == []


def test_mixing_reaches_targets(spark, docs):
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(copies())
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert sum(r[0].target for r in by.values()) == pytest.approx(sum(r.size for r in got))
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) and rows[0].target <= 3 * rows[0].source_size
    again = mixing.mix(docs.repartition(5)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in [type(again[0])(doc_id=r.doc_id, size=r.size, taken=r.taken) for r in got])
    assert mixing.mix(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 160, 3)] + [(3, None), (None, 1)], "doc_id long, quality int")
    with_texts = mixing.mix(docs, labels).select("doc_id", "source", "size", "target", "taken")
    without = mixing.mix_sized(mixing.label_quality(mixing.sized(docs).drop("text"), labels), F.col("_quality")).select(*with_texts.columns)
    assert sorted(map(str, with_texts.collect())) == sorted(map(str, without.collect()))


def test_targets_by_repeated_resharing(spark):
    rnd = random.Random(4)
    for _ in range(4):
        sizes = {f"s{k}": rnd.choice((0, 1, 5, 100, 10_000)) for k in range(9)} | {None: 50}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
        target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * sizes[s]}
            target |= {s: 3.0 * sizes[s] for s in over} if over else share
            left -= sum(3 * sizes[s] for s in over)
            open_ = open_ - over if over else set()
        assert got == pytest.approx(target)


def test_chat_layouts_and_escapes(spark):
    texts = ["a", "", "\\### Assistant: </turn> ok", "x\n### user:\ny</turn>\n", "\\\\h\\l\\b#<", "é😀"]
    records = [f'{{"messages":[{{"role":"user","content":{__import__("json").dumps(t)}}},{{"role":"assistant","content":{__import__("json").dumps(t)}}}]}}' for t in texts]
    records += ['{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":null}]}', '{"instruction":"do","output":"done"}', '{"output":"done","input":"this","instruction":"do"}', '{"other":1}', '{"messages":[]}', None]
    frame = spark.createDataFrame(list(enumerate(records)), "id int, json string").select("id", F.try_parse_json("json").alias("record"), F.lit(1).alias("turns"), F.lit(2).alias("layout"))
    out = chat.format_turns(chat.canonical_turns(frame)).select("id", "turns", "layout", "formatted", "mask", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).orderBy("id").collect()
    for r in out:
        assert r.back == r.turns and sum(m.length for m in r.mask) == len(r.formatted)
        at, marked = 0, []
        for m in r.mask:
            marked += [r.formatted[at : at + m.length]] if m.loss else []
            at += m.length
        assert len(marked) == sum(t.role == "assistant" for t in r.turns)
    assert [r.loss for r in out[: len(texts)]] == texts
    assert [(t.role, t.text) for t in out[6].turns] == [("user", "q"), ("assistant", "")]
    assert [(t.role, t.text) for t in out[8].turns] == [("user", "do"), ("user", "this"), ("assistant", "done")]
    assert [r.layout for r in out[9:]] == [None, None, None] and all(not r.turns for r in out[9:])


def test_chat_loss_is_cut_by_the_mask(spark):
    turns = [("user", "q#"), ("assistant", "a<\\" + "é😀" * 3000), ("assistant", ""), ("user", "z" * 5000), ("assistant", "end")]
    frame = spark.createDataFrame([(0, turns), (1, []), (2, [("user", "only")])], "id int, turns array<struct<role:string,text:string>>")
    out = chat.format_turns(frame).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("mask"))).orderBy("id")
    rows = out.collect()
    assert [r.loss for r in rows] == ["".join(t for role, t in turns if role == "assistant"), "", ""]
    shifted = F.transform("mask", lambda m, k: F.struct((m["length"] + F.when(k == 0, 1).otherwise(0)).alias("length"), m["loss"].alias("loss")))
    assert out.select(chat.read_loss(F.col("formatted"), shifted).alias("loss")).first().loss != rows[0].loss
    cut = F.array(F.struct(F.lit(1025).alias("length"), F.lit(False).alias("loss")), F.struct(F.lit(2048).alias("length"), F.lit(True).alias("loss")), F.struct(F.lit(3).alias("length"), F.lit(True).alias("loss")))
    text = "".join(chr(97 + k % 26) for k in range(4000))
    assert spark.range(1).select(chat.read_loss(F.lit(text), cut).alias("loss")).first().loss == text[1025:3076]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    gone = mit.split()
    gone[4], gone[15] = "x", "y"
    rows = [(1, "words " * 300 + licenses.TEMPLATES["GPL-3.0"] + " more" * 50), (2, mit.upper()), (3, " ".join(mit.split()[:8])), (4, None), (5, ""), (6, "license " * 100), (7, " ".join(gone)), (8, "text\n" * 20_000 + licenses.TEMPLATES["CC-BY-NC-4.0"])]
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("z"))).collect()}
    assert got == {(1, "GPL-3.0"), (2, "MIT-text"), (8, "CC-BY-NC-4.0")}
    assert licenses.n_bands(60, 20) >= 50 and 1 - (1 - 15 / 65) ** licenses.n_bands(60, 20) >= 1 - 1e-6


def test_licenses_of_few_words_inside_long_texts(spark):
    def found(rows, templates=None):
        return {(r.doc_id, r.license, r.n_shared, r.n_template) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}

    own = {"one": "Copyleft", "two": "Beerware license", "three": "All rights reserved.", "four": "Do what you want"}
    rows = [(k, "some words before " * 100 * k + f"({template})" + " and others after it" * 50) for k, template in enumerate(own.values(), 1)]
    rows += [(5, "all the rights are reserved " * 40), (6, "reserved rights all"), (7, "All Rights\nReserved"), (8, "do what you")]
    assert found(rows, own) == {(1, "one", 1, 1), (2, "two", 1, 1), (3, "three", 1, 1), (4, "four", 1, 1), (7, "three", 1, 1)}
    told = {name: "filler text " * 60 + licenses.TEMPLATES[name] + " filler text" * 60 for name in licenses.TEMPLATES}
    assert {(k, name) for k, name in enumerate(told)} <= {x[:2] for x in found([(k, text) for k, text in enumerate(told.values())])}
    assert {"All-rights-reserved", "LGPL-text", "AGPL-text", "CC0-1.0", "Proprietary"} <= set(licenses.TEMPLATES)


def test_decontamination_counts(spark):
    item = [f"w{k}é" for k in range(20)]
    bench = spark.createDataFrame([(10, " ".join(item)), (9, "Two Words"), (8, None), (7, "--"), (6, " ".join(item[:13]))], "item_id long, text string")
    rows = [(1, " ".join(item[:13])), (2, " ".join(item[2:14])), (3, "x " * 400 + "TWO, words"), (4, None), (5, ""), (6, "É".join(["a"] * 3)), (7, " ".join(item + item)), (7, "two words"), (None, "two words x")]
    got = {(r.doc_id, r.text): (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("?")), bench).collect()}
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert [got[r] for r in rows] == [
        (13, 13, 2, sha("10", "6"), True), (12, 0, 0, sha(), False), (402, 2, 1, sha("9"), False), (0, 0, 0, sha(), False), (0, 0, 0, sha(), False), (1, 0, 0, sha(), False),
        (40, 40, 2, sha("10", "6"), True), (2, 2, 1, sha("9"), True), (3, 2, 1, sha("9"), True),
    ]
    greek = spark.createDataFrame([(1, "one \u0391\u03a3.\u0392 two"), (2, "one \u03b1\u03c3")], "doc_id long, text string")
    found = decontaminate.decontaminate(greek, spark.createDataFrame([(1, "ONE \u0391\u03a3")], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 2, 2: 0}
    assert decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("masks", [1 << 20, 1])
def test_decontamination_behind_masks(spark, monkeypatch, masks):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(-1, "Two Words"), (-2, None)], "item_id long, text string"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "TWO, words x"), (-2, None), (None, "two words")], "doc_id long, text string"))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    result = lambda: collections.Counter(map(tuple, decontaminate.decontaminate(rows, bench).select(*columns).collect()))
    plain = result()
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", -1)
    monkeypatch.setattr(decontaminate, "MASKS", masks)
    assert result() == plain and sum(r[2] > 0 for r in plain) > 2


def test_html_main_text(spark):
    menu = "<div><span>Home of the site</span></div>"
    pages = [(k, "http://h.org/1", f"<body>{menu}<div><p>Own &amp; text {k}<br>more<p>second {k}</div></body>") for k in range(8)]
    pages += [(100, "u", None), (101, None, ""), (102, "http://o.org", "<article><h1>T</h1><p>a&nbsp;b <b>c</b><aside>no</aside></p><div class='comment-list'>no</div><script>x</script><ul><li>1<li>2</ul></article><footer>no</footer>"), (103, "x", "<p>open <b>text &lt;")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert [got[k] for k in range(8)] == [f"Own & text {k} more\nsecond {k}" for k in range(8)]
    assert (got[100], got[101], got[102], got[103]) == ("", "", "T\na b c\n1\n2", "open text <")


def html_texts(spark, pages):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_html_templates_go_wherever_they_stand(spark):
    menu = "<div><span>Home of the site</span></div>"
    twice = html_texts(spark, [(k, "http://h.org/1", f"<body>{menu}<div><p>Own text {k}</div><section>{menu}</section></body>") for k in range(8)])
    assert [twice[k] for k in range(8)] == [f"Own text {k}" for k in range(8)]


def test_html_templates_are_counted_over_pages_without_article(spark):
    menu = "<div><span>Home of the site</span></div>"
    pages = [(k, "http://h.org/1", f"<body>{menu}<div><p>Own text {k}</div></body>") for k in range(6)]
    got = html_texts(spark, pages + [(k, "http://h.org/1", f"<body>{menu}<article>Post {k}</article></body>") for k in range(100, 214)])
    assert [got[k] for k in range(6)] == [f"Own text {k}" for k in range(6)] and got[100] == "Post 100"


def test_html_copies_of_a_page_are_no_template(spark):
    copies = [(k, "http://h.org/1", f"<head><title>{k}</title></head><body><script>t({k})</script><div><p>The same main text</div></body>") for k in range(8)]
    got = html_texts(spark, copies + [(k, "http://h.org/1", f"<body><div><p>Own text {k}</div></body>") for k in range(100, 120)])
    assert {got[k] for k in range(8)} == {"The same main text"} and got[100] == "Own text 100"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><body><p>Main text</p></body></html>", "Main text"),
        ("<head><meta charset=utf-8><title>T</title>\n<style>p{}</style>\n<p>Main text", "Main text"),
        ("<head><title>T</title>\nMain text", "Main text"),
        ("<head><title>T</title><body><article><p>Main text</article>", "Main text"),
        ("<body><main><h1>H</h1><p>Main text</p><article class=card>Teaser</article></main></body>", "H\nMain text\nTeaser"),
        ("<body><div role=main><p>Main text</p></div><article>Teaser</article></body>", "Main text\nTeaser"),
        ("<body><main><nav>no</nav><article>One</article><article>Two</article></main></body>", "One\nTwo"),
        ("<body><div id=main><p>beside</p><article>One</article></div></body>", "One"),
        ("<body><main></main><article>One</article></body>", "One"),
    ],
)
def test_html_open_head_and_main_beside_articles(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article class="post share">Main text</article>', "Main text"),
        ('<article><p class="search-algorithms">On search</p><p class="related">On kin</p><p class="notice">On notice</p></article>', "On search\nOn kin\nOn notice"),
        ('<div class="header-image-post"><p>Main text</p></div>', "Main text"),
        ('<div class="header"><article>Main text</article></div>', "Main text"),
        ('<body class="sidebar"><div class="widget"><p>Main text of the page</p><div class="ad">Buy</div></div></body>', "Main text of the page"),
        ('<article>Post<div class="comment-list-2">Long comment of a reader</div></article>', "Post"),
        ('<p>Post</p><div class="post-comments"><p>Long comment of a reader</p></div>', "Post"),
        ('<article>Post<div class="cookie-banner">no</div><div id="ad_1">no</div><div class="social share-buttons">no</div><p class="ad">no</p><div class="side-bar">no</div><div class="privacy-notice">no</div></article>', "Post"),
        ('<main class="ad"><p>Main text</p></main>', "Main text"),
    ],
)
def test_html_class_words_do_not_eat_the_article(page, text):
    assert html_text.main_text(page) == text


def test_html_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    menu = "<div><span>Home of the site</span></div>"
    long = "word " * 200_000
    pages = [(k, f"http://h{k % 2}.org/1", f"<body>{menu}<div><p>Own text {k}</div></body>") for k in range(40)] * 2 + [(None, None, None), (99, "http://h1.org", f"<p>{long}")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_salt", F.lit("x")).withColumn("templates", F.lit(1))

    def texts():
        return sorted((-1 if r.page_id is None else r.page_id, r.url or "", r.text) for r in html_text.extract_text(frame).collect())

    by_broadcast = texts()
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert texts() == by_broadcast and len(by_broadcast) == 82
    assert by_broadcast[1] == by_broadcast[2] == (0, "http://h0.org/1", "Own text 0") and by_broadcast[-1][2] == long.strip()
    assert html_text.extract_text(frame.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    def brute(text):
        w = [x for x in (text or "").encode().split()]
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        return len({p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}), len(w)

    got = quality.quality_rules(docs).collect()
    assert len(got) == len(copies())
    for r in got:
        covered, n = brute(r.text)
        assert (r.n_repeat_words, r.n_words) == (covered, n)
        assert r.base_failed == (n < 20 or 100 * covered > 30 * n)
    some = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(60)) * 1), (2, " ".join(["aa bb"] * 40)), (3, " ".join(f"{k}# a$" for k in range(60))), (4, " ".join(f"q{k // 6}" for k in range(120)))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(some).collect()} == {1: True, 2: False, 3: False, 4: False}
    orders = [quality.quality_rules(some, rules=rules).select("doc_id", "kept").collect() for rules in (quality.RULES, quality.RULES[::-1])]
    assert orders[0] == orders[1]
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_cascade_keeps_what_the_rules_keep(spark, docs):
    """The lazy cascade gives the rows that the full judgement keeps, in any order of rules and with clashing columns."""
    clash = docs.withColumns({"_words": F.lit(1), "lines": F.lit("x"), "_row": F.lit(2), "_text": F.lit(3)})
    want = sorted(map(str, quality.quality_rules(docs).where("kept").select("doc_id", "text").collect()))
    rules = quality.BASE_RULES + quality.RULES
    assert 0 < len(want) < len(copies())
    for order in (rules, rules[::-1]):
        got = quality.kept_documents(clash, rules=order)
        assert got.columns == clash.columns
        assert sorted(map(str, got.select("doc_id", "text").collect())) == want
    assert quality.kept_documents(docs.limit(0)).count() == 0


def test_cascade_asks_no_rule_after_a_rejection(spark):
    """A rule that fails when it is computed is not reached by documents that an earlier rule rejects."""
    docs = spark.createDataFrame([("a",), ("",), (None,)], "text string")
    never = quality.Rule("never", lambda t: F.raise_error(F.lit("computed")).cast("boolean"))
    few = quality.Rule("few", lambda t: t.n_words < 5)
    chain = quality._chain([few, never], quality.Text("text", computed=False))
    assert quality._once(docs, _words=quality.words(F.col("text"))).select(chain.alias("by")).distinct().collect()[0].by == "few"


def test_cascade_costs(spark):
    """Costs come from the work of a rule: looking for repeated windows costs more than counting words; the rest is order."""
    docs = spark.createDataFrame([(" ".join(f"w{k * i}" for k in range(400)),) for i in range(1, 200)], "text string")
    rules = quality.BASE_RULES + quality.RULES
    found = dict(zip((r.name for r in rules), quality.measure(docs, rules), strict=True))
    assert found["repeated_windows"][1] > 5 * found["too_short"][1]
    assert all(rejected == 0 for rejected, _ in found.values())
    assert quality.cascade_order([(0, 5), (10, 100), (10, 10), (0, 1)]) == [2, 1, 3, 0]
    assert [quality.measure(docs.limit(0), rules)[k] for k in range(2)] == [(0, 0), (0, 0)]


def test_pipeline_over_whole_table(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= set(before) and len({r.doc_id for r in rows}) == len(rows)
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert all(0 < r.taken <= 3 * r["size"] for r in rows)
