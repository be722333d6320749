import numpy as np
import pytest

from meshtide.llm import html_extraction as H

from .conftest import rows_of

SF = "/root/testdata/sf0.1"

PARAS = ["First para, with words in it. Second sentence.", "Another para is here as well, it goes on.", "Third para goes on & on."]
BODY = "".join(f"<p>{t.replace('&', '&amp;')}</p>" for t in PARAS)
WANTED = "\n\n".join(["Title of it", *PARAS])
LAYOUTS = {
    "nested": f"<header><h1>Site</h1><a href=/>Home</a></header><div class=notice>We use cookies</div><main><article><header><h1>Title of it</h1></header>{BODY}"
              "<div class=ad>Buy now</div></article><section id=comments><h2>Comments</h2><p>I like this article, thank you for it.</p></section></main><aside><h3>Related</h3>"
              "<ul><li><a href=x>Other</a></li></ul></aside><form><p>Subscribe to us</p><button>Go</button></form><footer>Copyright</footer>",
    "plain": f"<div class=top><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div class=post><h1>Title of it</h1>{BODY}</div>"
             "<div class=sidebar><p>About me</p></div><div class=footer>Copyright 2020</div>",
    "advert inside": f"<nav><a href=/a>A</a></nav><article><h1>Title of it</h1><p>{PARAS[0]}<div class='ad'>Buy <b>this</b>.</div><p>{PARAS[1]}<p>Third para goes on &amp; on.</article>",
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return H.fit(pages)


def inside_article(page: str) -> str:
    held = H.Pages()
    held.add(page)
    return "\n\n".join(t for i, t in enumerate(held.texts) if "article" in held.around(i))


def test_given_pages_against_their_markup(pages, model):
    rows = {r.page_id: r.html for r in pages.collect()}
    found = H.main_texts(pages, model).collect()
    assert sorted(r.page_id for r in found) == sorted(rows) and all(r.n_chars == len(r.text) for r in found)
    right = np.mean([r.text == inside_article(rows[r.page_id]) for r in found])
    assert right >= 0.995


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_other_layouts(model, name):
    assert H.extract([LAYOUTS[name]], model) == [WANTED]


def test_random_layouts_held_out(pages, model):
    random, wrong, total = np.random.default_rng(1), 0, 0
    for r in pages.where("page_id % 7 = 0").limit(150).collect():
        texts, label = H.silver(r.html)
        page, label = H.laid_out([t for t, x in zip(texts, label, strict=True) if x], [t for t, x in zip(texts, label, strict=True) if not x], random)
        held = H.Pages()
        held.add(page)
        assert len(held.texts) == len(label)
        a = held.arrays()
        wrong += int(((H.odds(model, H.inputs(model, a), a["sizes"]) >= 0) != np.array(label)).sum())
        total += len(label)
    assert wrong / total < 0.02


@pytest.mark.parametrize("page, leaves", [
    ("", []), ("just text &lt;b&gt; &eacute;", ["just text <b> é"]), ("<p>one<p>two<br>lines\n here", ["one", "two lines here"]),
    ("a<script>var t='</p>'; b</script>c<!-- <p>no --><style>x", ["ac"]), ("<div>cut <b>of", ["cut of"]), ("<p title=\"a > b\">x</p> y < z", ["x", "y < z"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>1<td>2<tr><td>3</table>&nbsp;", ["1", "2", "3"]),
    ("<DIV CLASS=x>A&amp;amp;B</DIV></p></div>tail", ["A&amp;B", "tail"]), ("<p>x<script>", ["x"]), ("</ p>bogus<!DOCTYPE html", ["bogus"]), ("<p>" * 3000 + "deep", ["deep"]),
    ("<div>" * 3000 + "deep", ["deep"]),
])
def test_leaves(page, leaves):
    held = H.Pages()
    held.add(page)
    assert held.texts == leaves


def test_awkward_rows(spark, model):
    long = "<article><h1>T</h1>" + "<p>Some words of a sentence, again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p></p>"), (3, "w", long), (3, "w", long), (4, "x", "<nav><a href=/>Home</a></nav>")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    found = rows_of(H.main_texts(table, model))
    text = "\n\n".join(["T", *["Some words of a sentence, again."] * 20_000])
    assert found == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", "", 0), (3, "w", text, len(text)), (3, "w", text, len(text)), (4, "x", "", 0)], key=str)
    assert rows_of(H.main_texts(table.where("false"))) == []
    assert len(rows_of(H.main_texts(table.where("page_id = 1 or page_id = 4")))) == 2


def test_batches_do_not_change_a_page(pages, model, monkeypatch):
    some = [r.html for r in pages.limit(60).collect()] + [""]
    whole = H.extract(some, model)
    monkeypatch.setattr(H, "CELLS", 40)
    assert H.extract(some, model) == whole == [H.extract([p], model)[0] for p in some]


def test_gradients_against_differences():
    random = np.random.default_rng(0)
    held = H.Pages()
    for page in LAYOUTS.values():
        held.add(page)
    a, model = held.arrays(), {k: v.astype(np.float64) for k, v in H.start().items()}
    label = random.integers(0, 2, len(held.texts)).astype(np.float64)
    sizes = a["sizes"]
    starts, rows = np.cumsum(sizes) - sizes, np.arange(len(sizes))

    class Seen:
        def random(self, n):
            return np.zeros(n)

    def loss():
        p = H.sigmoid(H.odds(model, H.inputs(model, a), sizes))
        return -np.mean(np.where(label > 0, np.log(p), np.log(1 - p)))

    grads = H.gradients(model, a, label, rows, starts, sizes, Seen())
    for key in ("out", "bias", "wf", "ub", "cf", "name", "word"):
        flat = np.flatnonzero(np.abs(grads[key]) > np.abs(grads[key]).max() / 3)[:1][0]
        at = np.unravel_index(flat, grads[key].shape)
        old = model[key][at]
        model[key][at] = old + 3e-2
        up = loss()
        model[key][at] = old - 3e-2
        down = loss()
        model[key][at] = old
        assert abs((up - down) / 6e-2 - grads[key][at]) < 0.03 * abs(grads[key][at]) + 1e-4
