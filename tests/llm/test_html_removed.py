import pytest

from tidemark.llm import html_content as hc


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a <svg width='1'/> b</p><p>c", "a b c"),
        ("<p>a <math/> b</p><p>x <math><mi>y</mi></math> z", "a b x y z"),
        ("<title-bar>t</title-bar><object-card>o</object-card><p>b", "t o b"),
        ("<p>a<object><p>instead</p></object><p>b", "a instead b"),
        ("<p>a<select><option>q<p>b", "a q b"),
        ("<p>a<iframe src=x><p>b<svg><p>c", "a b c"),
        ("<head><title>T</title></head><p>a<svg><g/>no</svg>b<template>no</template><select>no</select>", "ab"),
        ("<p>a<style/>no</style>b<!-- no --><p>c<script>no", "ab c"),
    ],
)
def test_only_closed_elements_scripts_styles_and_comments_are_removed(html, want):
    t = hc.Trees()
    t.add(0, html)
    assert " ".join(text for _, _, text in t.runs) == want


def test_text_after_an_empty_drawing_is_kept(spark, sf):
    model = hc.train(spark.read.parquet(f"{sf}/pages.parquet"))
    html = "<html><body><nav><a href=x>Home</a></nav><article><p>First paragraph here, with words.</p><svg viewBox='0 0 1 1'/><p>Second paragraph here. It ends.</p></article></body></html>"
    out = hc.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), model).first()
    assert out.text == "First paragraph here, with words. Second paragraph here. It ends."
