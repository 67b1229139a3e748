import math
import re
from collections import defaultdict

from geolith.llm import langid

DOCS = [(i, t * 3, lang, 9) for i, (t, lang) in enumerate([("the cat sat on the mat with the dog", "en"), ("der hund und die katze sind im haus", "de"), ("le chat est sur la table avec le chien", "fr")] * 5)] + [(99, None, "en", 9), (98, "no language", None, 9)]
PAGES = [
    (1, "https://a.x.org/1", '<html lang="en-US"><body>the dog sat with the cat</body>', 0), (2, "https://b.x.org/2", "<html lang='de'>die katze und der hund", 0),
    (3, "https://a.x.org/3", "<p>das haus<script>the the the</script>", 0), (4, None, "<html lang=fr>", 0), (5, "nothing", None, 0), (6, "http://u@Y.com:80/?q", "", 0),
    (6, "http://u@Y.com:80/?q", "", 0), (7, "https://b.x.org/z", "le chat " * 3000, 0), (None, "https://b.x.org/z", "&amp;<b></b>", 0),
]


def tables(spark, pages=PAGES, docs=DOCS):
    return spark.createDataFrame(pages, "page_id long, url string, html string, score long"), spark.createDataFrame(docs, "doc_id long, text string, lang string, own long")


def brute(rows, langs):
    """Bayes' rule over evidence rows with dictionaries; counts leave the page itself out."""
    by = {k: defaultdict(lambda: [0] * len(langs)) for k in ("declared", "suffix", "host", "domain")}
    for r in rows:
        for k in by:
            by[k][r[k]] = [a + b for a, b in zip(by[k][r[k]], r["own"], strict=True)]
    total = [sum(r["own"][k] for r in rows) for k in range(len(langs))]
    out = []
    for r in rows:
        logs = []
        for k in range(len(langs)):
            own = r["own"][k]
            x = r["score"][k] / 1000
            for what in ("declared", "suffix"):
                x += math.log((by[what][r[what]][k] - own + langid.PSEUDO) / (total[k] - own + langid.PSEUDO * len(by[what])))
            base = (total[k] + langid.PSEUDO) / (sum(total) + langid.PSEUDO * len(langs))
            mass = sum(r["own"])
            domain = (by["domain"][r["domain"]][k] - own + langid.DOMAIN_WEIGHT * base) / (sum(by["domain"][r["domain"]]) - mass + langid.DOMAIN_WEIGHT)
            logs.append(x + math.log((by["host"][r["host"]][k] - own + langid.HOST_WEIGHT * domain) / (sum(by["host"][r["host"]]) - mass + langid.HOST_WEIGHT)))
        best = max(logs)
        out.append((r["page_id"], langs[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)))
    return out


def test_fusion_against_brute_force(spark):
    pages, docs = tables(spark)
    langs, table = langid.train(docs)
    assert langs == ["de", "en", "fr"]
    rows = langid.evidence(pages, langs, table)
    got = sorted((r.page_id or 0, r.lang, round(r.probability, 4)) for r in langid.fused(rows, langs).collect())
    assert got == sorted((i or 0, lang, round(p, 4)) for i, lang, p in brute([r.asDict() for r in rows.collect()], langs))


def test_evidence_parts(spark):
    pages, docs = tables(spark)
    r = {x.page_id: x for x in langid.evidence(pages, *langid.train(docs)).collect()}
    assert (r[1].declared, r[1].host, r[1].domain, r[1].suffix) == ("en", "a.x.org", "x.org", "org")
    assert (r[4].declared, r[4].host, r[5].host, r[6].host) == ("fr", "", "", "y.com")
    assert list(r[4].score) == [0, 0, 0] and max(r[7].score) == 0 == r[7].score[2]
    assert {x.page_id: x.lang for x in langid.identify(pages, docs).collect()}[3] == "de"


def test_empty_and_unlabelled(spark):
    pages, docs = tables(spark)
    assert langid.identify(tables(spark, [])[0], docs).collect() == []
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_accuracy_on_pages(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.page_id: re.search("/(en|de|fr|es)/", r.url)[1] for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect() if re.search("/(en|de|fr|es)/", r.url)}
    got = langid.op6_language_id(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/pages.parquet").count()
    assert sum(truth.get(r.page_id, r.lang) == r.lang for r in got) >= 0.98 * len(got)
