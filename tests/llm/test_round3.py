"""Pages that lost their text, links seen from one side, key-like lines, labels by the million."""

import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import html_text, neighbours, secrets, urls

ENGLISH = "The cat and the dog were in the house of a man who had been there for a long time. " * 4
OTHER = {
    "Russian": "Эти слова не стоят ни в одном из списков, и всё же страница рассказывает о погоде на севере страны, где зима длится долго. " * 3,
    "Greek": "Αυτή η σελίδα μιλάει για τον καιρό στα βουνά και για τους ανθρώπους που ζουν εκεί όλο τον χρόνο μαζί με τα ζώα τους. " * 3,
    "Chinese": "这个页面讲述了北方的冬天以及人们如何度过漫长的夜晚和寒冷的早晨。" * 4,
    "Polish": "Opowieść dotyczy pogody oraz ludzi mieszkających wysoko wśród gór przez cały rok razem ze swoimi zwierzętami. " * 3,
}


@pytest.mark.parametrize(
    "before",
    ["<datalist><option value=a></datalist>", "<select><option>x<option>y</select>", "<iframe src=x>", "<svg viewBox='0 0 1 1'>", "<textarea>", "<template>", "<noscript>", "<iframe src=x><iframe src=y></iframe>"],
)
@pytest.mark.parametrize("body", ["<article><p>{}</p><p>{}</p></article>", "<div>{}</div><div>{}</div>"])
def test_raw_elements_without_an_end_take_nothing(before, body):
    got = html_text.extract(f"<html><body>{before}{body.format(ENGLISH, ENGLISH)}<select><option>no</option></select></body></html>")
    assert got == f"{ENGLISH.strip()}\n\n{ENGLISH.strip()}"


def test_raw_elements_with_an_end_still_go():
    page = f"<svg><svg><text>inner</text></svg><text>outer</text></svg><iframe>fallback</iframe><template><p>{ENGLISH}</p></template><script>if (a < b) '<p>'</script><p>{ENGLISH}</p><style>p {{}}"
    assert html_text.extract(page) == ENGLISH.strip()
    assert html_text.extract(f"<p>{ENGLISH}</p><script>document.write('<p>{ENGLISH}') // no end") == ENGLISH.strip()


@pytest.mark.parametrize("language", OTHER)
@pytest.mark.parametrize("tag", ["div", "p", "article"])
def test_pages_of_any_language(language, tag):
    t = OTHER[language].strip()
    page = f"<nav><a href=1>{t[:30]}</a></nav><ul><li><a href=2>{t[:40]}</a></li></ul>" + f"<{tag}>{t}</{tag}>" * 4 + f"<footer>{t[:90]}</footer>"
    assert html_text.extract(page) == "\n\n".join([t] * 4)


def test_pages_without_a_decided_block():
    t = "Gates 5 and 6, platform 12, tickets 30 euros, return tickets 50 euros, groups 20."
    assert html_text.extract(f"<div>{t}</div>") == t and html_text.extract("<nav>Home</nav><div>Short.</div>") == ""


def test_many_unclosed_elements_are_read_once():
    start = time.perf_counter()
    assert html_text.extract("<svg><iframe>" * 30_000 + f"<p>{ENGLISH}</p>") == ENGLISH.strip()
    assert time.perf_counter() - start < 10


def _ssh_key(public: int) -> str:
    part = lambda b: len(b).to_bytes(4, "big") + b
    r = random.Random(public)
    return base64.b64encode(b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(r.randbytes(public)) + part(r.randbytes(300))).decode()


@pytest.mark.parametrize("public", [50, 5_000, 65_536])
def test_ssh_keys_with_long_public_halves(public):
    key = _ssh_key(public)
    lines = "\n".join(key[i : i + 70] for i in range(0, len(key), 70))
    for text in (f"x\n{lines}\n\nafter it", f"x {key} after"):
        found = [s for s in secrets.find_secrets(text) if s.kind == "base64_key"]
        assert len(found) == 1 and "".join(text[found[0].start : found[0].end].split()) == key


def test_key_like_lines_take_time_by_their_length():
    r = random.Random(2)
    took = {}
    for n in (4_000, 16_000):
        lines = ["MIIEvQIBADANBgkqhkiG9w0BAQEFAASC" + "".join(r.choice("ABCDEFabcdef0123") for _ in range(32)) for _ in range(n)]
        best = []
        for _ in range(2):
            start = time.perf_counter()
            secrets.find_secrets("\n".join(lines))
            best.append(time.perf_counter() - start)
        took[n] = min(best)
    assert took[16_000] < 8 * took[4_000] + 0.2


def mixture(seed=4):
    """Isotropic vectors, a minority that varies in few directions, and planted links."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(2600, 32))
    x[:400] = r.normal(size=(400, 5)) @ r.normal(size=(5, 32))
    x[2300:] = x[r.integers(0, 2300, 300)] + r.normal(size=(300, 32)) * 0.23
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("exact", [False, True])
def test_links_count_at_both_ends(spark, monkeypatch, exact):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 40)
    x = mixture()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in neighbours.embedding_components(df, exact=exact).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert n.sum() % 2 == 0  # every link counts twice
    if exact:
        assert n.tolist() == near.sum(1).tolist()
    else:
        assert near.sum() * 0.99 <= n.sum() <= near.sum() and (n <= near.sum(1)).all()


def test_items_of_labels_that_share_a_token_by_the_million(spark):
    """More baskets than sums of their hashes would have room for in 64 bits, at a cost of one column each."""
    n = 20_000_000
    t = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("s:https"), F.lit("h:a"))).otherwise(F.array(F.lit("s:http"))).alias("t"), (F.col("id") % 4 == 0).alias("bad"))
    assert {r.token: r["item"] for r in urls.items_of(t).collect()} == {"s:https": "h:a", "h:a": "h:a", "s:http": "s:http"}


def test_mined_rules_hold_on_pages_not_mined(spark):
    """Urls that tell: what half of the pages teaches, the other half bears out."""
    host = F.concat(F.when(F.col("id") % 5 == 0, "casino-win").when(F.col("id") % 5 == 1, "library").otherwise(F.concat(F.lit("site"), F.col("id") % 40)), F.lit(".org"))
    rows = spark.range(6000).select("id", F.concat(F.lit("https://www."), host, F.lit("/a/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 5 == 0, F.col("id") % 50 != 0).otherwise(F.col("id") % 50 == 1).alias("bad"))
    mined = urls.mine_rules(rows.where("id % 2 = 0").select("url", "bad"))
    assert mined
    got = urls.filter_urls(rows.where("id % 2 = 1").withColumnRenamed("id", "page_id"), [], mined).join(rows.select(F.col("id").alias("page_id"), "bad"), "page_id")
    counts = {(r.verdict, r.bad): r["count"] for r in got.groupBy("verdict", "bad").count().collect()}
    assert counts["block", True] >= 0.95 * (counts["block", True] + counts.get(("block", False), 0)) and counts["block", True] > 500
