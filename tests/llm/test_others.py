"""Sharding, urls, mixing, lines, chat and personal data."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from structlake.llm import chat, pii
from structlake.llm.common import matching
from structlake.llm.line_dedup import line_dedup
from structlake.llm.mixing import id_hash, mix, mixed
from structlake.llm.sharding import ShardStore, shard
from structlake.llm.url_filter import RULES, judge_urls

from .data import empty, frame, odd, rows


# --- sharding ---------------------------------------------------------------------


def test_shards_hold_every_row_and_commit_versions(spark, tmp_path):
    docs = frame(spark).withColumn("arrival", F.pmod("doc_id", F.lit(6)))
    store = shard(docs, f"file://{tmp_path}/s", by="arrival", fan_in=3, least_bytes=1)
    assert store.version() >= 2 and len(store.runs()) < 6
    assert sorted(map(str, store.read(docs.schema).collect())) == sorted(map(str, docs.collect()))
    assert sum(r.rows for r in store.runs()) == docs.count()
    before = store.version()
    assert not store.commit(before - 1, []), "a version is committed once"
    assert store.commit(before, store.runs()) and store.version() == before + 1


def test_shards_of_odd_tables(spark, tmp_path):
    store = shard(empty(spark), f"file://{tmp_path}/e")
    assert store.version() == 0 and store.read(empty(spark).schema).count() == 0
    strange = odd(spark).withColumn("arrival", F.pmod("doc_id", F.lit(6)))
    assert shard(strange, f"file://{tmp_path}/o", by="arrival").read(strange.schema).count() == 7


def test_tiers_merge_similar_sizes(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/t", fan_in=2, least_bytes=1)
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10))
    assert len(store.runs()) == 4 and store.compact(spark.range(1).schema) >= 2
    assert sorted(r.id for r in store.read(spark.range(1).schema).collect()) == list(range(40))


def test_versions_stay_readable_until_a_vacuum(spark, tmp_path):
    schema = "id long, _run string"
    store = ShardStore(spark, f"file://{tmp_path}/v", fan_in=2, least_bytes=1 << 20)
    part = lambda k: spark.createDataFrame([(j, f"a b%{j % 2}") for j in range(k * 10, k * 10 + 10)], schema)
    store.append(part(0), by="_run")
    first = store.version()
    store.append(part(1))
    planned = store.read(schema)
    before, merges = store.version(), store.compact(schema)
    assert merges == 2 and len(store.runs()) == 1 and store.history().filter(f"version = {first}").count() == 2
    assert sorted(r.id for r in planned.collect()) == list(range(20)), "a reader that planned before the merge"
    assert sorted(r.id for r in store.read(schema, first).collect()) == list(range(10))
    assert {r._run for r in store.read(schema).collect()} == {"a b%0", "a b%1"}
    # a writer that died before its commit
    part(2).write.parquet(f"file://{tmp_path}/v/data/lost")
    assert list(store.orphans()) == ["data/lost"]
    assert store.vacuum() == [], "young runs stay"
    assert store.vacuum(versions=100, older_than=0) == ["data/lost"] and before in store.versions()
    assert len(store.vacuum(versions=1, older_than=0)) == 4 and store.versions() == [store.version()]
    assert sorted(r.id for r in store.read(schema).collect()) == list(range(20))
    with pytest.raises(ValueError):
        store.read(schema, first)


# --- urls ------------------------------------------------------------------------------


def brute_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls_equal_brute_force(spark, limit):
    rng = random.Random(4)
    rules = [*RULES, ("block", "a.example.org", "/fr/x"), ("allow", "deep.a.example.org", "/fr/xy/"), ("block", "com", ""), ("allow", "net", "/a"), ("block", "net", "/ab/c")]
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/1?q", "x://y://z/", "http://example.net#/en/", "http://" + "a." * 300 + "net/" + "p/" * 300, "http://net/\nen"]
    urls += [f"https://{rng.choice(['', 'm.', 'deep.a.', 'xn.b.', 'bad'])}example.{rng.choice(['net', 'org', 'com', 'COM'])}{rng.choice(['', '/', '/en/', '/de/q', '/fr/xyz', '/fr/xy/z', '/a', '/ab/cd', '/en'])}{rng.choice(['', '?a=/de/', '#t'])}" for _ in range(300)]
    pages = spark.createDataFrame([(k % 290, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), broadcast_bytes=limit)
    want = Counter((k % 290, *brute_url(u, rules)) for k, u in enumerate(urls))
    assert Counter(map(tuple, got.collect())) == want


def test_urls_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert judge_urls(none, rules).count() == 0
    assert [r.verdict for r in judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), rules).collect()] == ["allow"]


# --- mixing -----------------------------------------------------------------------------------


def brute_mix(some):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in some}
    names = sorted({r[3] for r in some}, key=lambda x: (x is None, x))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total = {n: sum(size[r[0]] for r in some if r[3] == n) for n in names}
    open_, left, target = set(names), 1.5 * sum(total.values()), {}
    while open_:
        full = [n for n in open_ if left * weight[n] / sum(weight[m] for m in open_) > 2 * total[n]]
        if not full:
            target |= {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
            break
        for n in full:
            target[n] = 2 * total[n]
            left -= target[n]
            open_.remove(n)
    return size, total, target


@pytest.mark.parametrize("bits", [12, 2, 60])
def test_mix_meets_targets(spark, bits):
    some = rows()
    size, total, target = brute_mix(some)
    got = {r.doc_id: r for r in mix(frame(spark), level_bits=bits).collect()}
    hashes = {r[0]: r[1] for r in frame(spark).select("doc_id", id_hash(F.col("doc_id"))).collect()}
    for n in total:
        ids = [r[0] for r in some if r[3] == n]
        taken = sum(got[i].taken for i in ids)
        assert abs(taken - target[n]) <= max(size[i] for i in ids) / 2 + 1e-6
        for i in ids:
            assert got[i].size == size[i] and got[i].source_size == total[n]
            assert got[i].target == pytest.approx(target[n]) and got[i].taken in (0, size[i], 2 * size[i])
        once = sorted((hashes[i], got[i].copies) for i in ids if size[i])
        assert [c for _, c in once] == sorted((c for _, c in once), reverse=True), "nested by hash"
    assert Counter(r.doc_id for r in mixed(frame(spark)).collect()) == Counter({i: got[i].copies for i in got if got[i].copies})


def test_rows_of_one_id_in_two_sources_are_mixed_apart(spark):
    docs = [(k, "one two three four", "A") for k in range(10)] + [(4, "five six", "B"), (4, "five six seven", "C"), (4, "five six seven", "C"), (None, "x", None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = Counter()
    for r in mix(table).collect():
        want[r.doc_id, r.size] += r.taken // r.size
    got = Counter((r.doc_id, len(r.text.split())) for r in mixed(table).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_rows_of_one_id_come_near_their_target(spark):
    """Null ids, and three ids that all rows repeat; rows of one id and text go together."""
    docs = [(None, " ".join([f"w{k}"] * 20), "A") for k in range(100)] + [(k % 3, " ".join([f"v{k}"] * 15), "B") for k in range(100)] + [(7, "same text", "C")] * 10
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for bits in (12, 60):
        got = mix(table, level_bits=bits).collect()
        for name, size in (("A", 20), ("B", 15)):
            mine = [r for r in got if r.size == size]
            assert len(mine) == 100 and abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2
        assert len({r.taken for r in got if r.size == 2}) == 1
    want = Counter()
    for r in mix(table).collect():
        want[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len(r.text.split())) for r in mixed(table).collect()) == Counter({k: v for k, v in want.items() if v})


def test_mix_edges(spark):
    assert mix(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0
    assert mix(odd(spark)).count() == 7
    assert mixed(frame(spark)).columns == frame(spark).columns


# --- lines -------------------------------------------------------------------------------------------


def test_lines_equal_brute_force(spark):
    some = rows()
    sites: dict = {}
    for r in some:
        for line in (r[1] or "").split("\n"):
            if len(line.strip(" ")) >= 20:
                sites.setdefault(line.strip(" "), set()).add(r[3])
    bad = {k for k, v in sites.items() if len(v) >= 5}
    assert bad
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(frame(spark)).collect()}
    for r in some:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        assert got[r[0]] == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_lines_far_above_the_threshold(spark):
    docs = [(k, f"a line of boilerplate that is everywhere\nonly here is line {k} of them", f"site{k}") for k in range(300)]
    got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string, source string"), lg_k=8).collect()
    assert all(r.n_removed == 1 for r in got)


def test_rows_match_keys_sent_whole_or_by_slots(spark):
    rows_ = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("h"))
    keys = spark.createDataFrame([(1,), (5,)], "h long")
    for limit in (1 << 20, 0):
        assert sorted(r.id for r in matching(rows_, keys, ["h"], F.col("id"), limit).collect()) == [k for k in range(1000) if k % 7 in (1, 5)]


def test_lines_edges(spark):
    assert line_dedup(empty(spark)).count() == 0
    assert line_dedup(odd(spark)).count() == 7


# --- chat -----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\\\### x </turn>\n", "### Assistant: hi </turn>\n", "#", "</turn", " </turn> ", "a" * 50000 + "</turn>" + "\\" * 999, "é\U0001f600\n\n", ": :", "$1 \\$"]
    said = [(c, t, r, nasty[(c * 5 + t) % len(nasty)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2 :])]
    said += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(130)] + [(60, 1, "user", "x"), (60, 1, "user", "x"), (60, None, None, "first"), (None, 0, "ro:le\\", "null tree")]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    done = chat.chat_conversations(chat.chain_messages(table))
    got = {r.conv_id: r for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want: dict = {}
    for c, t, r, x in sorted(said, key=lambda m: (m[0] is None, m[0], m[1] is not None, m[1], m[2] or "", m[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == want.keys()
    for c in want:
        assert [(t.role, t.text) for t in got[c].turns] == want[c], c
        assert got[c].loss == "".join(x for r, x in want[c] if r == "assistant")


def test_branches_are_ranked(spark):
    tree = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 2, None), (1, 6, 2, 2.0), (2, 1, 9, 0.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 2, 1.0)]
    msgs = spark.createDataFrame(tree, "tree long, id long, up long, score double")
    got = chat.reply_paths(msgs, "tree", "id", "up", "score", branches=2).collect()
    paths: dict = {}
    for r in got:
        paths.setdefault((r.tree, r["rank"]), {})[r.depth] = r.node
    assert {k: [v[d] for d in sorted(v)] for k, v in paths.items()} == {(1, 1): [1, 3, 4], (1, 2): [1, 2, 6], (2, 1): [1]}


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_conversations(chat.chain_messages(none)).count() == 0


# --- personal data -----------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    for rank, (kind, (pattern, ok)) in enumerate(kinds.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    parts = ["a.b@c.d", "@", "x@y", "é", "\U0001f600", " ", "4539578763621486", "4539 5787-6362 1486", "4539578763621487", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "010.0.0.255", "+1 (555) 555-1234", "+49 30 1234567", "+1", "00", "-", ".", "_d@e.f", "9" * 25, "\n", "(555) 555-1234", "joe [at] mail dot com", "\x01", "123.45.67.89@h.org"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += [None, "", "7" * 30000, "a" * 30000, "a@" * 5000, "+1 " * 5000, "1.2.3.4 " * 2000, "1.1" * 4000, "4539578763621486 " * 1000]
    docs = spark.createDataFrame([(k, t, "b", "e") for k, t in enumerate(texts)], "doc_id long, text string, base string, extra string")
    got = {r.doc_id: r for r in pii.find_pii(docs, train_rows=4000).collect()}
    for k, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[k].base] == brute_pii(t), t and t[:200]


def test_clean_texts_and_base_spans_get_no_more_spans(spark):
    rng = random.Random(9)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    docs = [(k, f"word phone: +1 {number()} word" if k % 2 else f"order {rng.randint(100, 999)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} of stock") for k in range(600)]
    docs += [(1000 + k, "nothing here at all 12 and 3") for k in range(20)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(len(got[k].base) == k % 2 for k in range(600))
    assert all(not got[k].extra for k in range(0, 600, 2)) and all(not got[1000 + k].extra for k in range(20))


def planted_pii(seed):
    """Texts and, by id, the extra spans that must be found: kind and text."""
    rng = random.Random(seed)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    docs, want = [], {}
    for k in range(900):
        name, host = f"ann{rng.randint(0, 999)}", f"host{rng.randint(0, 99)}"
        national, address = number(), rng.choice([f"{name} [at] {host} dot org", f"{name} [at] {host} [dot] org", f"{name} [at] {host}.org"])
        text = [f"call phone: +1 {number()} word", f"call phone: {national} word", f"write mail: {name}@{host}.org today", f"write mail: {address} today", f"order {rng.randint(100, 999)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} of stock"][k % 5]
        docs.append((k, text))
        want[k] = {1: {("phone", national)}, 3: {("email", address)}}.get(k % 5, set())
    return docs, want


def test_common_national_numbers_and_written_out_addresses_are_found(spark):
    docs, want = planted_pii(10)
    texts = dict(docs)
    got = {r.doc_id: {(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.extra} for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_a_small_table_has_its_trees_too(spark):
    docs, want = planted_pii(11)
    texts = dict(docs[:60])
    got = {r.doc_id: {(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.extra} for r in pii.find_pii(spark.createDataFrame(docs[:60], "doc_id long, text string")).collect()}
    found = sum(len(got[k] & want[k]) for k in texts)
    assert found >= 0.9 * sum(len(want[k]) for k in texts)
    assert sum(len(got[k] - want[k]) for k in texts) <= 0.02 * found


def test_held_out_precision_of_the_added_spans(spark):
    """Spans of other formats are hidden from the labels and judged afterwards."""
    rng, docs, want = random.Random(12), [], {}
    for k in range(1500):
        card = "".join(str(rng.randint(0, 9)) for _ in range(15))
        card += next(str(d) for d in range(10) if luhn(card + str(d)))
        grouped = ".".join(card[i : i + 4] for i in range(0, 16, 4))
        ip = [str(rng.randint(1, 255)) for _ in range(4)]
        forms = [
            (f"my card {card} is old", None),
            (f"my card {grouped} is old", ("card", grouped)),
            (f"the host {'.'.join(ip)} is down", None),
            (f"the host {' . '.join(ip)} is down", ("ip", " . ".join(ip))),
            (f"part number {rng.randint(1000, 9999)}.{rng.randint(1000, 9999)}.{rng.randint(1000, 9999)}.{rng.randint(1000, 9999)} in stock", None),
            (f"scores were {rng.randint(300, 999)} , {rng.randint(300, 999)} , {rng.randint(300, 999)} , {rng.randint(300, 999)} points", None),
        ]
        text, extra = forms[k % 6]
        docs.append((k, text))
        want[k] = {extra} - {None}
    texts = dict(docs)
    got = {r.doc_id: {(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.extra} for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    right = sum(len(got[k] & want[k]) for k in texts)
    assert right >= 0.95 * sum(map(len, want.values()))
    # part numbers that pass Luhn by chance have no cue
    assert sum(len(got[k] - want[k]) for k in texts) <= 0.02 * right


def test_redaction_and_edges(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.cd or 1.2.3.4."), (2, None), (3, "no"), (3, "no"), (None, "x a@b.cd")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in pii.redact(docs).collect()) == sorted([("1", "é mail [email] or [ip]."), ("2", None), ("3", "no"), ("3", "no"), ("None", "x [email]")], key=str)
    assert pii.find_pii(empty(spark)).count() == 0
    assert pii.find_pii(odd(spark)).count() == 7
    assert hashlib.sha256(b"").hexdigest()


def test_rule_hosts_are_lowered_like_those_of_urls(spark):
    rules = spark.createDataFrame([("block", "Ä.COM", "/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://Ä.com/x"), (2, "http://ä.com/x"), (3, "http://b.Ä.CoM/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_repeated_message_ids_give_one_turn(spark):
    said = [("t", 1, None, "user", "hello"), ("t", 1, None, "user", "hello"), ("t", 2, 1, "assistant", "b"), ("t", 2, 1, "assistant", "a"), ("u", 1, None, "user", "other"), ("t", None, 1, "user", "no id")]
    rows = spark.createDataFrame(said, "conv_id string, message long, parent long, role string, text string")
    got = chat.chat_conversations(rows).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [(x.role, x.text) for x in r.turns] for r in got} == {"t": [("user", "hello"), ("assistant", "a")], "u": [("user", "other")]}
