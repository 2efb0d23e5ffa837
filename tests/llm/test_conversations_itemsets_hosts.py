"""Conversation repair, closed itemsets and URL reputation against brute force, with nulls, ties, repeated rows, empty tables, long texts and clashing column names."""

import hashlib
import random
from functools import cache
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lakescribe.llm.conversations import Determinised, conversation_reports, damaged, repaired_turns
from lakescribe.llm.hosts import judged_urls, reputations
from lakescribe.llm.itemsets import Itemsets, closed_itemsets
from lakescribe.llm.oracles import BASKETS, REPAIR, URLS
from lakescribe.llm.queries import URL_RULES, queries
from tests.oracle import assert_same, rows_of, session


@pytest.mark.parametrize("name, sql", [("op11_conversation_repair", REPAIR), ("op12_itemsets", BASKETS), ("op13_url_filter", URLS)])
def test_queries_equal_sql(name, sql):
    assert_same(session(), queries()[name], sql, "/root/testdata/sf0.001")


def cheapest(symbols):
    """Cost and edits by trying all, with at most two inserted rows at a time: initials and flags are kept as they are, no states."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, last, inserted):
        ways = []
        if inserted < 2:
            for to in after[last]:
                if to != "s":
                    cost, rest = best(i, to, inserted + 1)
                    ways.append((cost + 3, "I" + rest))
        if i == len(symbols):
            if last in ("", "a"):
                ways.append((0, ""))
            return min(ways, default=(10**6, ""))
        initial, must_go, cut = symbols[i]
        cost, rest = best(i + 1, last, 0)
        ways.append((cost + 4, "D" + rest))
        if not must_go:
            if initial in after[last]:
                cost, rest = best(i + 1, initial, 0)
                ways.append((cost + 3 * cut, "K" + rest))
            for to in after[last]:
                if to != "s":
                    cost, rest = best(i + 1, to, 0)
                    ways.append((cost + 3 + 3 * cut, "R" + rest))
        return min(ways)

    return best(0, "", 0)


def test_automaton_gives_the_cheapest_least_edits():
    rng, automaton = random.Random(3), Determinised()
    for _ in range(3000):
        symbols = [(rng.choice("suaax"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        coded = bytes(8 if gone else "suax".index(initial) + 4 * cut for initial, gone, cut in symbols)
        assert automaton.audit(coded[::-1]) == cheapest(tuple(symbols))
    assert len(automaton.vectors) < 60
    cost, audit = automaton.audit(bytes([1, 2] * 200_000)[::-1])
    assert (cost, audit) == (0, "K" * 400_000)


LONG = "word " * 40_000
TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 5, "user", "cut off"), (1, 5, "user", "cut off"), (1, None, "tool", "x."), (1, 6, "assistant", " \t\n"),
    (2, 0, "user", LONG), (2, 1, "assistant", LONG + "."), (3, None, None, None), (3, None, None, None), (4, 2, "assistant", "b."), (4, 2, "assistant", "a."), (4, 2, "user", "c?\n"),
    (None, 0, "user", "q?"), (None, 1, "assistant", "a!"), (5, 0, "system", "Only."), (6, -(2**62), "user", "a."), (6, 2**62, "assistant", "b."), (7, 0, "Usher", ""),
]


def reports(rows):
    """The contract's columns of ``rows`` (conv, turn, role, text), by the cheapest edits over whole lists."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv)
        seen, symbols, faults = set(), [], []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x", faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = cheapest(tuple(symbols))
        turns = {r[1] for r in own if r[0]}
        made, left = [], list(own)
        for letter in audit:
            _, _, role, text = left.pop(0) if letter != "I" else (0, 0, "", "")
            lead = bool(made) and made[0][:1] == "s"
            new = ("user", "assistant")[(len(made) - lead) % 2]
            if letter != "D":
                made.append(f"{role if letter == 'K' else new}:{text}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def turns_table(rows):
    return session().createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "conv_id long, turn long, role string, text string, pos int, symbol string, fault int, conv int")


def test_conversation_reports():
    table = turns_table(TURNS)
    none = turns_table([(9, 0, "user", "x")]).unionByName(table)
    got = {r[0]: tuple(r)[1:] for r in conversation_reports(table, none).collect()}
    assert got.pop(9) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == reports(TURNS)
    assert conversation_reports(table.limit(0), table.limit(0)).count() == 0


def test_repaired_turns():
    rows = repaired_turns(turns_table(TURNS)).collect()
    want = reports(TURNS)
    for conv, facts in want.items():
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["step"])
        assert "".join(r["edit"] for r in own) == facts[6]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D").encode()).hexdigest() == facts[7]
        assert [r["pos"] for r in own if r["edit"] != "I"] == list(range(1, 1 + sum(r["edit"] != "I" for r in own)))
    assert repaired_turns(turns_table([])).count() == 0


def test_damage():
    import zlib

    rows = [(c, t, "assistant", "Is it? Yes. No!") for c in [*range(40), None] for t in [*range(4), None]]
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if d == 0 else [(c, t, "user" if d == 4 else role, "" if d == 1 else "Is it Yes No" if d == 2 else text)] * (2 if d == 3 else 1)
    assert sorted(map(repr, (tuple(r) for r in damaged(turns_table(rows)).collect()))) == sorted(map(repr, want))


def brute_sets(rows, least, share):
    baskets = {}
    for basket, item in rows:
        if basket is not None and item is not None:
            baskets.setdefault(basket, set()).add(item)
    least = max(least, -(-len(baskets) // share))
    held, level = {}, {(i,): {b for b, x in baskets.items() if i in x} for i in {i for x in baskets.values() for i in x}}
    while level := {k: v for k, v in level.items() if len(v) >= least}:
        held |= level
        level = {a + (b[-1],): level[a] & level[b] for a in level for b in level if a[:-1] == b[:-1] and a[-1] < b[-1]}
    larger = {}
    for k, v in held.items():
        for c in k:
            larger[tuple(x for x in k if x != c)] = max(len(v), larger.get(tuple(x for x in k if x != c), 0))
    out = {}
    for k, v in held.items():
        if larger.get(k, 0) < len(v):
            rules = []
            for c in k if len(k) > 1 else ():
                a, s = len(held[tuple(x for x in k if x != c)]), len(held[c,])
                if 100 * len(v) >= 60 * a and len(v) * len(baskets) > a * s:
                    rules.append((c, a, s))
            out[k] = (len(v), rules)
    return out


def lines(rows):
    return session().createDataFrame([(b, i, 1, 2, 3) for b, i in rows], "sale_id long, item_id long, rank int, support int, basket int")


def shop(seed, hot, high=40):
    """Baskets with bundles, one item in most of them, equal supports, and ``hot`` baskets of all items."""
    rng, rows = random.Random(seed), []
    bundles = [rng.sample(range(-5, high), rng.randint(2, 4)) for _ in range(6)]
    for b in range(150):
        items = set(rng.sample(range(-5, high), rng.randint(1, 4))) | (set(rng.choice(bundles)) if rng.random() < 0.6 else set()) | ({3} if rng.random() < 0.7 else set())
        rows += [(b, i) for i in items for _ in range(rng.randint(1, 2))]
    rows += [(1000 + h, i) for h in range(hot) for i in range(-5, high)]
    return rows + [(None, 3), (2000, None), (None, None)]


@pytest.mark.parametrize("hot, high, heavy, ordinary", [(3, 40, 2_000_000, 8), (3, 40, 60, 8), (6, 5, 200, 4)])
def test_closed_itemsets(hot, high, heavy, ordinary):
    rows = shop(hot, hot, high)
    got = closed_itemsets(lines(rows), least=4, share=20_000, heavy=heavy, ordinary=ordinary).collect()
    assert len({tuple(r["items"]) for r in got}) == len(got)
    assert {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in got} == brute_sets(rows, 4, 20_000)


def test_heavy_databases_are_split():
    sets = Itemsets(lines(shop(1, 1)), "sale_id", "item_id", 4, 20_000, 40, 8)
    assert sets.depth > 1 and sets.split.count() > 5
    assert closed_itemsets(lines([])).count() == 0
    same = [(b, i) for b in range(9) for i in (1, 2, 3)]
    assert [tuple(r) for r in closed_itemsets(lines(same)).select("items", "support").collect()] == [([1, 2, 3], 9)]


def pages(urls):
    return session().createDataFrame([(i, u, "x", 1, 2.0, True) for i, u in enumerate(urls)], "page_id long, url string, host string, k int, n double, _salt boolean")


def test_rules_and_hosts():
    urls = [
        None, "", "no scheme", "http://a.com/x", "http://A.COM/?q#f", "https://a.com", "ftp://notcom/x", "http://example.com/en/1", "http://b.example.com/en/", "http://www.example.com/en/x?y", "http://x.www.example.com/en/",
        "http://example.com/fr/", "http://n.net/es/1", "http://n.net/es", "http://n.net?/es/", "http://ünÏ.Net/fr/#a", "http://h.org:80/p?q", "x://y://z/é", "http://n.net/es/1", "http://" + "a." * 300 + "net/fr/" + "p" * 50_000,
    ]
    rows = {r["page_id"]: r for r in judged_urls(pages(urls), URL_RULES).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert rows[i]["verdict"] == (max(fits)[2] if fits else rows[i]["verdict"]) and rows[i]["verdict"] in ("allow", "block")
    assert judged_urls(pages([]), URL_RULES).count() == 0
    assert {r["verdict"] for r in judged_urls(pages(urls), []).collect()} == {"allow"}


def test_reputation_is_shrunk_towards_domain_and_suffix():
    spark = session()
    seen = [("bad.shop.co.uk", 30, 30), ("b.shop.co.uk", 9, 10), ("good.co.uk", 0, 50), ("fine.net", 1, 40), ("x.net", 0, 3), ("y.spam.org", 40, 40), ("new.spam.org", 1, 1), ("empty.org", 0, 0)]
    asked = [h for h, _, _ in seen] + ["c.shop.co.uk", "other.co.uk", "never.seen", "localhost", ""]
    got = {r["host"]: r for r in reputations(spark.createDataFrame(seen, "host string, k long, n long"), spark.createDataFrame([(h,) for h in asked], "host string")).collect()}

    def domain(h):
        return ".".join(h.split(".")[-3 if h.endswith(".co.uk") else -2 :]), "co.uk" if h.endswith(".co.uk") else h.split(".")[-1]

    levels = [{}, {}, {}, {}]
    for h, k, n in seen:
        d, s = domain(h)
        for level, key in zip(levels, ("", s, d, h)):
            a, b = level.get(key, (0, 0))
            level[key] = (a + k, b + n)
    levels = [{k: v for k, v in level.items() if v[1]} for level in levels]
    parent = [None, lambda s: "", lambda d: domain(d)[1], lambda h: domain(h)[0]]
    weights = []
    for depth in (1, 2, 3):
        s = a = b = 0.0
        for key, (k, n) in levels[depth].items():
            pk, pn = levels[depth - 1][parent[depth](key)]
            p = pk / pn
            s, a, b = s + n * (k / n - p) ** 2, a + p * (1 - p), b + p * (1 - p) * (n - 1)
        rho = min(0.9, max(0.001, (s - a) / b if b else 0.001))
        weights.append((1 - rho) / rho)
    k, n = levels[0][""]
    for h in asked:
        d, s = domain(h)
        m = (k + 0.5) / (n + 1)
        for depth, key in ((1, s), (2, d), (3, h)):
            a, b = levels[depth].get(key, (0, 0))
            m, size = (a + weights[depth - 1] * m) / (b + weights[depth - 1]), b + weights[depth - 1]
        bound = m - 1.645 * (m * (1 - m) / (size + 1)) ** 0.5
        assert got[h]["reputation"] == pytest.approx(m) and got[h]["bound"] == pytest.approx(bound) and got[h]["blocked"] == (bound > 0.5)
    assert got["bad.shop.co.uk"]["blocked"] and not got["good.co.uk"]["blocked"] and not got["never.seen"]["blocked"]


def test_a_hot_host_is_judged_like_others():
    spark = session()
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, F.lit("http://hot.net/en/")).otherwise(F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".net/es/"))).alias("url"))
    got, columns = judged_urls(rows, URL_RULES).groupBy("host", "verdict").count().collect(), ["host", "verdict", "count"]
    assert len(rows_of(columns, got)[0]) == 51 and sum(r["count"] for r in got) == 3000
