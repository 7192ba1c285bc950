"""Templates of hosts without article elements and with meaningless class names."""

import numpy as np

from tallywright.llm import html_text


def pages():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows = []
    for k in range(40):
        paragraphs = [" ".join(rng.choice(words, 12)) for _ in range(int(rng.integers(1, 6)))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        extra = "<div class=q1><div class=q2><p>Buy our things</p></div><div class=q3>Now cheaper</div></div>" if k % 3 == 0 else ""
        html = f"<body><div class=k1><ul><li>Home</li><li>News</li><li>About</li></ul></div>{extra}<div class=k2><div>{body}</div></div><div class=k3><p>All rights reserved</p></div></body>"
        rows.append((k, f"http://host{k % 2}/x{k}", html, "\n".join(paragraphs)))
    return rows


def test_templates_decide(spark):
    rows = pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(got[k] == text for k, _, _, text in rows)
    assert all(html_text.main_text(html) != text for _, _, html, text in rows)


def test_classes_inside_slots(spark):
    # the tags t1 to t3 stand on the same five pages, but around them is a tag that is in no class
    inner = "<div class=w><div class=t1></div><div class=t2></div><div class=t3>Said often</div></div>"
    rows = [(k, "http://h/", f"<body><div class=a><b>Top</b></div><div class=m><p>{k} words</p>{inner if k < 5 else '<div class=w></div>' if k < 7 else ''}</div></body>") for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[2] == "2 words\nSaid often" and got[9] == "9 words"


def test_copies_and_names(spark):
    copies = [(k, "http://c/", "<body><div class=a>One</div><div class=b>Two</div><div class=c>Three</div></body>") for k in range(8)]
    got = html_text.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"One\nTwo\nThree"}
    inside = "<article><p>a</p><div class='side-effects'>b</div><div class='related-posts'>c</div><div class='user-comments'>d</div><div class='ad-slot'>e</div><div class='related-work'>f</div><p>g"
    assert html_text.main_text(inside) == "a\nb\nf\ng"
    assert html_text.main_text("<article><div class='side-effects") == ""
    assert html_text.main_text("<body>" + "<div>" * 3000 + "deep") == "deep"
