import pytest

from lumenset.operators.markup import audit_html, repair_html, strip_code_fence

FULL = '<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="x"></head><body>a</body></html>'


def run(spark, job, texts, *args):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return job(df, "t", *args).orderBy("id").collect()


def test_complete_page_is_left_alone(spark):
    assert run(spark, repair_html, [FULL])[0].t == FULL


def test_missing_parts_are_added(spark):
    bare, no_head, upper, empty, null = run(
        spark, repair_html, ["<p>x</p>", "<!DOCTYPE html><html><body>y</body></html>", "<HTML><HEAD></HEAD><BODY></BODY></HTML>", "", None]
    )
    assert bare.t.startswith('<!DOCTYPE html>\n<head><meta name="viewport"')
    assert bare.t.endswith("<p>x</p>\n</html>") and "<html lang='en'>" in bare.t and bare.t.count("<body>") == 1
    assert no_head.t.startswith("<!DOCTYPE html><html>\n<head><meta name=")
    assert upper.t.startswith('<!DOCTYPE html>\n<HTML><HEAD><meta name="viewport"') and '<meta charset="UTF-8">' in upper.t
    assert "No dashboard content" in empty.t and "No dashboard content" in null.t


def test_repair_twice_changes_nothing(spark):
    texts = ["<p>x</p>", "<html><body>y</body></html>", "", "  <!doctype html><div>", "<head>", FULL, "<html lang='de'><p>"]
    once = [r.t for r in run(spark, repair_html, texts)]
    assert [r.t for r in run(spark, repair_html, once)] == once


def test_libraries_in_use_are_loaded(spark):
    page = '<!DOCTYPE html><html><head><meta charset="utf-8"><meta name="viewport" content="x"></head><body>new Chart(); d3.select()</body></html>'
    repaired = run(spark, repair_html, [page])[0].t
    chart, d3 = ('<script src="https://cdn.jsdelivr.net/npm/chart.js"></script>\n', '<script src="https://d3js.org/d3.v7.min.js"></script>\n')
    assert f"{chart}{d3}</head>" in repaired and repaired.count("<script") == 2
    assert run(spark, audit_html, [repaired])[0].unloaded_libraries == "" and run(spark, repair_html, [repaired])[0].t == repaired


def test_audit(spark):
    row, bad = run(spark, audit_html, [FULL, "<script>new Chart(d3)</script>"])
    assert (row.has_doctype, row.has_html, row.has_head, row.has_charset, row.has_body, row.has_viewport, row.has_csp) == (True,) * 6 + (False,)
    assert row.unloaded_libraries == "" and bad.unloaded_libraries == "Chart,d3" and not bad.has_head


@pytest.mark.parametrize(
    "text, want",
    [
        ("```html\n<p>a</p>\n```", "<p>a</p>"),
        ("  ```html<p>a</p>", "<p>a</p>"),
        ("```\nabc\n```  ", "abc"),
        ("```abc", "abc"),
        ("```", ""),
        ("``````", ""),
        (" plain ```x``` ", "plain ```x```"),
        ("```html\na ``` b", "a ``` b"),
        ("```html\na ``` b\n``` \n", "a ``` b"),
    ],
)
def test_code_fence(spark, text, want):
    assert run(spark, strip_code_fence, [text])[0].t == want
