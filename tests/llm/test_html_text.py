import numpy as np
import pytest

from termloom.llm.html_text import HIDDEN, BlockLabeller, blocks, extract_text, features, generated_pages, trained

SCHEMA = "page_id long, url string, html string, text string"


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b\n\n c</p>", ["a", "b c"]),
        ("<p><b>a<br><p>b</p>", ["a", "b"]),
        ("<p>x&nbsp;<i>y</i>z&#233;&lt;p&gt;", ["x yzé<p>"]),
        ("<head><title>t</title><style>s</style></head><body><script>var t='</p>';</script>b", ["b"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><!-- open", ["yes"]),
        ("<form><select><option>x</select><textarea>y</textarea><label>z</label></form>", ["z"]),
        ("</p></div>a</b>b<p", ["ab<p"]),
        ("<script>never closed <p>x</p>", []),
        ("<p title='open>a</p><b class=\"x>y\">b</b>", ["a", "b"]),
        ("<title>t</title junk>a<p <b>c", ["a", "c"]),
        ("a<b", ["a<b"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_held_out_accuracy():
    model, wrong, total = trained(), 0, 0
    for page, labels in generated_pages(150, seed=123):
        found = blocks(page)
        assert len(found) == len(labels)
        if found:
            wrong += int(((model.label([found])[0] >= 0.5) != np.array(labels)).sum())
            total += len(labels)
    assert wrong / total < 0.03


def test_long_pages_are_read_whole():
    model = BlockLabeller.untrained(np.random.default_rng(2))
    for side in "fb":  # a network that forgets little: every block depends on the whole page
        model.w[f"b{side}"][HIDDEN : 2 * HIDDEN] = 9
    page = "<nav><a href=/a>Home</a></nav>" + "".join(f"<p>{'word ' * (i % 40 + 1)}{i}</p>" for i in range(2_500)) + "<footer>end</footer>"
    found = blocks(page)
    assert len(found) == 2_502
    x = features(found)[:, None]
    whole = model.forward(x, np.ones(x.shape[:2], np.float32), learn=False)[0][:, 0]
    assert np.abs(model.label([found])[0] - whole).max() < 1e-5
    short = blocks("<p>a short page</p>")
    for p, want in zip(model.label([found, short, [], found[:9]], steps=7), model.label([found, short, [], found[:9]]), strict=True):
        assert len(p) == len(want) and np.allclose(p, want, atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(1)
    model = BlockLabeller.untrained(rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.standard_normal((5, 2, model.w["wf"].shape[0])) * 0.2
    mask = np.ones((5, 2))
    mask[3:, 1] = 0
    y = rng.integers(0, 2, (5, 2)).astype(float)
    loss = lambda: -((y * np.log(p := model.forward(x, mask)[0]) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()
    p, saved = model.forward(x, mask)
    grads = model.gradients(p, y, mask, saved)
    for name in model.w:
        at = tuple(rng.integers(0, s) for s in model.w[name].shape)
        before = model.w[name][at]
        model.w[name][at] = before + 1e-3
        up = loss()
        model.w[name][at] = before - 1e-3
        down = loss()
        model.w[name][at] = before
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at]), name


def test_extraction(spark):
    words = "The river ran past the old mill and nobody spoke for a while"
    page = f"""<html><head><title>t</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
        <div class="ad">Buy now</div><article><h1>{words}</h1><p>{words}.</p><p>{words} &amp; {words}</p></article>
        <section class="comments"><p>nice post</p></section><footer>&copy; 2020</footer></body></html>"""
    rows = [(1, "u", page, "old"), (2, None, None, None), (3, "e", "", None), (1, "u", page, "old"), (4, "l", "<p>" + "long words " * 50_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(extract_text(df).collect(), key=lambda r: r["page_id"])
    assert [r["page_id"] for r in out] == [1, 1, 2, 3, 4]
    assert out[0]["text"] == out[1]["text"] == f"{words}\n{words}.\n{words} & {words}"
    assert [r["text"] for r in out[2:4]] == ["", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract_text(df.limit(0)).collect() == []
