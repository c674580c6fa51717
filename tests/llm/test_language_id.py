import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trajectra.llm.language_id import WEIGHT, declared_language, host_of, identify_languages, registered_domain, train_text_model, visible_text

LETTERS = {"aa": "abcdeflm", "bb": "nopqrstu", "cc": "vwxyzghi"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(3, 9))) for _ in range(n))


def docs(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    return spark.createDataFrame([*rows, (90, None, "aa"), (91, "x", None)], "doc_id long, text string, lang string")


def test_evidence_is_combined(spark):
    rng = random.Random(2)
    page = lambda lang, n, tag: f"<html lang='{tag}'><script>var nopq='nnnn'</script><p>{words(rng, lang, n)}</p></html>"
    rows = [(i, f"http://x{i % 3}.{lang}.org/", page(lang, 30, lang)) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(100, "http://x0.aa.org/", page("aa", 30, "bb")), (101, "http://x1.bb.org/", "<html lang=bb></html>"), (102, "http://x2.cc.org/q", None), (103, None, page("cc", 10, "zz")), (None, "nothing", ""), (104, "https://u@NEW.host:80/", page("bb", 20, "bb-BB"))]
    out = {r["page_id"]: r for r in identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs(spark)).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["language"] == lang for i, lang in enumerate(["aa", "bb", "cc"] * 30))
    # Clear text outweighs a wrong declaration; without text, declaration and host decide.
    assert out[100]["language"] == "aa" and out[101]["language"] == "bb" and out[102]["language"] == "cc" and out[103]["language"] == "cc"
    assert out[104]["host"] == "new.host" and out[104]["declared"] == "bb"
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in out.values())


def test_parts(spark):
    df = spark.createDataFrame([("<HTML class=x lang = \"En-us\"><style>p{}</style>a<b>b</b>&nbsp;<!-- c -->d",), (None,)], "h string")
    rows = df.select(declared_language(df.h).alias("l"), visible_text(df.h).alias("t")).collect()
    assert rows[0]["l"] == "en" and rows[0]["t"].split() == ["a", "b", "d"] and rows[1]["l"] is None and rows[1]["t"] == ""
    urls = spark.createDataFrame([("ftp://h.Example.COM:8/x",), ("no url",), (None,)], "u string")
    assert [r[0] for r in urls.select(host_of(urls.u)).collect()] == ["h.example.com", None, None]


def test_text_model_and_empty(spark):
    model = train_text_model(docs(spark))
    assert model.languages == ["aa", "bb", "cc"]
    assert model.evidence("abcdef lmabc").argmax() == 0 and (model.evidence("") == 0).all()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert identify_languages(none, docs(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", "x")], "page_id long, url string, html string")
    assert identify_languages(one, docs(spark).limit(0)).first()["language"] is None


def brute(pages, model):
    """Posteriors by the formula, on dictionaries. pages: id, host, domain, suffix, declared, text."""
    evidence = [model.evidence(p[5]) for p in pages]
    own = [np.exp(e) / np.exp(e).sum() for e in evidence]
    prior = (sum(own) + 1) / (len(pages) + len(model.languages))
    sums = [defaultdict(lambda: [np.zeros(len(prior)), 0]) for _ in range(4)]
    for p, o in zip(pages, own):
        for s, key in zip(sums, p[1:5]):
            if key:
                s[key][0] = s[key][0] + o
                s[key][1] += 1
    out = []
    for p, e, o in zip(pages, evidence, own):
        def share(level, above):
            total, n = sums[level][p[1 + level]] if p[1 + level] else (o, 1)
            return (total - o + WEIGHT * above) / (n - 1 + WEIGHT)

        x = e + np.log(share(0, share(1, prior))) + np.log(share(2, prior)) + np.log(share(3, prior)) - 2 * np.log(prior)
        out.append(np.exp(x - x.max()) / np.exp(x - x.max()).sum())
    return out


def test_posteriors_by_brute_force_on_awkward_pages(spark):
    """Null, repeated and very long pages, hosts that hold most rows, ties, clashing column names."""
    rng = random.Random(5)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 7}'}.{rng.choice(['x.org', 'y.co.uk', 'z.aa', 'w.de'])}/{i}", f"<html lang={rng.choice(['aa', 'bb', 'cc', 'q'])}>{words(rng, rng.choice(['aa', 'bb', 'cc']), rng.randrange(6))}") for i in range(150)]
    rows += [rows[0]] * 3 + [(None, None, None), (None, None, None), (7, "host", ""), (8, "http://localhost/", words(rng, "aa", 30_000)), (9, "http://a.b.c.co.uk", "<html lang='bb'>1 2 3</html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = train_text_model(docs(spark))
    parts = df.select("page_id", host_of(F.col("url")).alias("h"), declared_language(F.col("html")).alias("d"), visible_text(F.col("html")).alias("t"))
    parts = parts.select("page_id", "h", registered_domain(F.col("h")).alias("r"), F.regexp_extract("h", r"\.([^.]+)$", 1).alias("s"), "d", "t").collect()
    want = sorted((repr(p["page_id"]), [round(float(x), 9) for x in q]) for p, q in zip(parts, brute([tuple(p) for p in parts], model)))
    clash = df.selectExpr("*", "url as id", "html as text", "page_id as host", "url as declared", "1 as suffix", "2 as own", "3 as evidence", "4 as host_n")
    got = identify_languages(clash, docs(spark)).collect()
    assert sorted((repr(r["page_id"]), [round(x, 9) for x in r["posterior"]]) for r in got) == want
    assert all(r["language"] == model.languages[int(np.argmax(r["posterior"]))] and r["probability"] == max(r["posterior"]) for r in got)


def test_registered_domains(spark):
    names = {"a.b.example.com": "example.com", "x.co.uk": "x.co.uk", "w.x.co.uk": "x.co.uk", "co.uk": "co.uk", "localhost": "", "a.net.br": "a.net.br", "my.site.org": "site.org"}
    df = spark.createDataFrame(list(names.items()), "h string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", registered_domain(F.col("h")).alias("got")).collect())
