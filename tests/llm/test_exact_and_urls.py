import hashlib
import re

from granary.llm.exact_dedup import exact_dedup, keep_first_copies
from granary.llm.url_filters import ALLOW, BLOCK, HOST_RULES, PATTERN_RULES, Rule, filter_urls, rarest_literals, read_rules

DOCS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "ÀB"), (6, "àb"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "ab"), (9, "ab"), (None, "ab"), (10, None)]


def brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return sorted((str(i), max(x for x in groups[lower(t)] if x is not None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def test_classes_match_brute_force_and_one_row_of_each_stays(spark):
    df = spark.createDataFrame(DOCS * 3, "doc_id long, text string").repartition(5)
    rows = exact_dedup(df, salts=2).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute(DOCS * 3)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_the_last_of_repeated_rows_stays_at_the_ends_of_the_ids(spark):
    rows = [(-(2**63), "a"), (None, "A"), (2**63 - 1, "b"), (2**63 - 1, "B"), (None, "c"), (None, "c")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), with_place=True).collect()
    assert sorted(r["_uid"] for r in got if r.kept) == [0, 3, 5]
    assert [r.keep_id for r in sorted(got, key=lambda r: r["_uid"])] == [-(2**63)] * 2 + [2**63 - 1] * 2 + [None] * 2


def test_dedup_keeps_columns_of_any_name_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 5, "k"), (1, "a", 5, "k"), (2, "b", None, None)], "doc_id long, text string, keep_id long, _place string")
    assert sorted(tuple(r) for r in keep_first_copies(df).collect()) == [(1, "a", 5, "k"), (2, "b", None, None)]
    assert keep_first_copies(df.limit(0)).collect() == [] and exact_dedup(df.limit(0)).collect() == []


URLS = [
    "http://a.com/en/1", "http://example.com/en/7", "http://x.example.com/en/78?x", "https://notexample.com/en/7", "http://EXAMPLE.net/de/8#f", "http://b.net/de/9", "http://o.org/es/", "http://o.org/ES/", "ftp://com/en/",
    "http://com:80/en/", None, "", "no-scheme.com/en/", "http://", "http://spam-farm.example.org/x", "http://ads.q.com/", "http://q.com/wp-login.php", "http://q.com/robots.txt", "http://a/?u=http://b.com/en/", "http://a.b\nc/x", "HTTP://a.com/en/1",
]


def expected(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def test_host_rules_by_hand_and_both_indexes_agree(spark):
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS * 2)], "page_id int, url string, _tokens string")
    inline = sorted(filter_urls(df).collect(), key=lambda r: r.page_id)
    joined = sorted(filter_urls(df, max_inline=0).collect(), key=lambda r: r.page_id)
    assert [tuple(r) for r in inline] == [tuple(r) for r in joined]
    for r in inline:
        host, path, rule, verdict = expected(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert verdict in (None, r.verdict)
    own = {r.url: r.verdict for r in inline if r.rule is None}
    assert own["http://spam-farm.example.org/x"] == own["http://ads.q.com/"] == own["http://q.com/wp-login.php"] == BLOCK
    assert own["http://q.com/robots.txt"] == own[None] == own[""] == ALLOW


def test_no_url_that_an_expression_fits_is_lost_by_the_index(spark):
    parts = ["spam-farm.", "xspam-farm.x", "ads.", "adserver.q", "xads.", "?utm_source=spam", "&utm_source=casino", "?utm_source=spammy", "/wp-login.php", "/wp-login.php5", "/xmlrpc.phpx?a", "/WP-LOGIN.php", "/robots.txt", "/robots.txtx"]
    urls = [f"{scheme}{a}{b}" for scheme in ("http://", "http://q.com/x", "") for a in ["", *parts] for b in ["", *parts]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for how in ({}, {"max_inline": 0}):
        for rules in [[r] for r in PATTERN_RULES] + [PATTERN_RULES]:
            got = {r.url: r.verdict for r in filter_urls(df, rules=rules, **how).collect()}
            for u in urls:
                fits = {r.verdict for r in rules if re.search(r.pattern, u)}
                assert got[u] == (BLOCK if fits == {BLOCK} else ALLOW), (u, rules)


def test_rules_come_from_a_file_and_stand_under_each_alternative(spark, tmp_path):
    (tmp_path / "rules.jsonl").write_text('{"verdict": "block", "host": "a.com", "path": "/x"}\n{"verdict": "allow", "pattern": "/(one|two)/", "any_of": ["one", "two"]}\n')
    rules = read_rules(spark, str(tmp_path / "rules.jsonl"))
    assert rules == [Rule(BLOCK, "a.com", "/x"), Rule(ALLOW, pattern="/(one|two)/", any_of=("one", "two"))]
    df = spark.createDataFrame([(1, "http://b/one/")], "page_id int, url string")
    assert set(rarest_literals(df, "url", rules + PATTERN_RULES)) >= {"one", "two", "ads", "adserver", "doubleclick", "wp", "xmlrpc"} and "" not in rarest_literals(df, "url", PATTERN_RULES)


def test_no_rules_no_rows_and_tokens(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id int, url string")
    assert filter_urls(df, rules=[]).first().verdict == ALLOW
    assert filter_urls(df.limit(0)).collect() == []
    assert Rule(ALLOW, "example.com", "/en/7").tokens == ["com", "en", "example"]
    assert [r.tokens for r in PATTERN_RULES][0] == ["farm", "spam"]
