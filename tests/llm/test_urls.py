import math
from collections import Counter, defaultdict

from conftest import MIDDLE, SMALL
from pyspark.sql import functions as F

from lectern.llm import urls
from lectern.llm.queries import URL_RULES, op6_urls
from lectern.session import table


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


CASES = [None, "", "no scheme", "http://EXAMPLE.net/en/a?b", "http://a.example.net/en", "https://x.org/fr/1#t", "https://org/fr/", "http://notexample.com/de/", "http://example.com/de/x", "http://y.example.com?de/", "a://b://c.net/", "http://É.NET/", "http://net/", "http://x.net", "http://a\nb.net/x\ny?z"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(k, u, "r", 1.0) for k, u in enumerate(CASES)], "page_id int, url string, rule string, score double")
    found = urls.filter_urls(pages, URL_RULES).collect()
    assert [tuple(r)[1:4] for r in sorted(found)] == [brute(u) for u in CASES]
    for r in found:
        assert r["verdict"] == URL_RULES.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, {}).collect()} == {"allow"}


def is_held():
    return F.pmod(F.xxhash64("url"), F.lit(urls.HELD_OUT)) == 0


def test_model_separates_what_rules_decide(spark):
    """On rule-decided URLs that no model was counted from."""
    unseen = table(spark, MIDDLE, "pages").where(is_held()).select("page_id")
    rows = op6_urls(spark, MIDDLE).where("rule IS NOT NULL").join(unseen, "page_id").collect()
    right = sum((r["score"] >= r["threshold"]) == (r["verdict"] == "allow") for r in rows)
    assert len(rows) >= 50 and right >= 0.75 * len(rows)


def test_scores_and_threshold_by_brute_force(spark):
    """Witten-Bell models and the calibration over plain dictionaries, for every URL of the table."""
    pages = {r["page_id"]: (r["url"], r["held"]) for r in table(spark, SMALL, "pages").select("page_id", "url", is_held().alias("held")).collect()}
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    verdicts = {k: URL_RULES.get(brute(url)[2]) for k, (url, _) in pages.items()}

    def steps(url):
        text = urls.START + url + urls.END
        return [(text[max(0, k - urls.ORDER) : k], text[k]) for k in range(1, len(text))]

    for k, (url, held) in pages.items():
        if verdicts[k] and not held:
            for context, following in steps(url):
                for size in range(len(context) + 1):
                    counts[verdicts[k]][context[len(context) - size :]][following] += 1
    alphabet = max(2, len({c for own in counts.values() for c in own[""]})) + 1

    def chance(own, context, following):
        shorter = chance(own, context[1:], following) if context else 1 / alphabet
        seen = own.get(context)
        return (seen[following] + len(seen) * shorter) / (seen.total() + len(seen)) if seen else shorter

    expected = {}
    for k, (url, _) in pages.items():
        logs = [math.log(chance(counts["allow"], *s)) - math.log(chance(counts["block"], *s)) for s in steps(url)]
        expected[k] = sum(logs) / len(logs)
    found = {r["page_id"]: r for r in op6_urls(spark, SMALL).collect()}
    for k, r in found.items():
        assert abs(r["score"] - expected[k]) < 1e-9
        assert r["verdict"] == (verdicts[k] or ("allow" if r["score"] >= r["threshold"] else "block"))
    good = [expected[k] for k, (_, held) in pages.items() if held and verdicts[k] == "allow"]
    bad = [expected[k] for k, (_, held) in pages.items() if held and verdicts[k] == "block"]
    gap = lambda edge: abs(sum(s < edge for s in good) / len(good) - sum(s >= edge for s in bad) / len(bad))
    edges = [(round(s / urls.BIN) + d - 0.5) * urls.BIN for s in good + bad for d in (0, 1)]
    assert gap(found[min(found)]["threshold"]) <= min(map(gap, edges)) + 1e-9


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "http://x.net/a", 0.5, "v"), (1, "http://x.net/a", 0.5, "v"), (None, "http://y.org/", 1.0, "w"), (2, "http://z.com/" + "q" * 100_000, 0.0, "u")]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string, score double, verdict string"), URL_RULES).collect()
    assert len(found) == 4 and len({tuple(r) for r in found if r["page_id"] == 1}) == 1


def test_rare_contexts_count(spark):
    """A context far below any share of the characters counts in full, wherever its step is looked up."""
    texts = ["http://example.net/en/" + "abcdefgh" * 2000] * 30 + ["http://x.net/" + "abcdefgh" * 2000] * 30
    texts += [f"http://example.net/en/zq{k}jxw" for k in range(9)] + [f"http://x.net/jq{k}zxw" for k in range(9)] + [None, "", "http://y.org/zq1jxw", "http://y.org/jq1zxw"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id int, url string")
    score = lambda share: {r["page_id"]: r["score"] for r in urls.filter_urls(pages, URL_RULES, sent_share=share).collect()}
    sent, joined, usual = score(0.0), score(2.0), score(urls.SENT_SHARE)
    for k in sent:
        assert abs(sent[k] - joined[k]) < 1e-9 and abs(sent[k] - usual[k]) < 1e-9
    assert usual[len(texts) - 2] - usual[len(texts) - 1] > 0.1
