"""Pages that cut-down extraction got wrong."""

from textloom.llm import html_extract as H


def text_of(html, template=frozenset()):
    return H.main_text(*H.parse(html), template)


def test_deep_pages_stay_balanced():
    for depth in (70, 5000):
        deep = "<div>" * depth + "%s" + "</div>" * depth
        assert text_of(f"<body><div id=page><article>{deep % 'deep'}<p>rest</p></article></div></body>") == "deep rest"
        assert text_of(f"<body><article>{deep % 'deep<nav>menu</nav><div class=comments>words</div>'}<p>rest</p></article></body>") == "deep rest"
    shape = H.skeleton(H.parse("<div><x>" * 3000)[0])
    assert len(H.align(shape, shape)) == 6001


def texts(spark, pages):
    rows = [(i, f"http://h.example.org/{i}", html) for i, html in enumerate(pages)]
    return [r.text for r in sorted(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_copies_of_an_article_are_not_template(spark):
    copy = "<body><nav>menu %d</nav><div class=ad>advert %d</div><article><h1>Title</h1><p>The one article</p><blockquote>its quote</blockquote></article><footer>foot %d</footer></body>"
    copies = [copy % (i, i, i) for i in range(8)]
    assert texts(spark, copies) == ["Title The one article its quote"] * 8
    # Only the copies fill the quote.
    others = [f"<body><article><h1>T{i}</h1><p>other article {i}</p></article></body>" for i in range(7)]
    assert texts(spark, copies + others) == ["Title The one article its quote"] * 8 + [f"T{i} other article {i}" for i in range(7)]


def test_every_layout_has_a_wrapper(spark, monkeypatch):
    posts = [f"<body><article><h1>T{i}</h1><p>post number {i}</p></article></body>" for i in range(12)]
    wikis = [f"<body><main><div class=lead><h2>W{i}</h2></div><table><tr><td>entry number {i}</td></tr></table><p class=fixed>notice</p></main></body>" for i in range(6)]
    assert texts(spark, posts + wikis) == [f"T{i} post number {i}" for i in range(12)] + [f"W{i} entry number {i}" for i in range(6)]
    monkeypatch.setattr(H, "FIRST_LOOK", 1)  # several rounds
    assert texts(spark, posts + wikis) == [f"T{i} post number {i}" for i in range(12)] + [f"W{i} entry number {i}" for i in range(6)]


def test_one_other_wording_leaves_a_template(spark):
    page = "<body><article><h1>T%d</h1><p>post number %d</p><p class=fixed>%s</p></article></body>"
    found = texts(spark, [page % (i, i, "notice" if i else "Notice!") for i in range(20)])
    assert found == [f"T{i} post number {i}" for i in range(20)]
    # A part that the commonest skeleton lacks.
    plain = "<body><article><h1>T%d</h1><p>post number %d</p></article></body>"
    found = texts(spark, [page % (i, i, "notice") if i < 6 else plain % (i, i) for i in range(20)])
    assert found == [f"T{i} post number {i}" for i in range(20)]


def test_the_varying_text_is_the_content(spark):
    pages = [f"<body><div class=slogan>our site</div><div class=content><h1>T{i}</h1><p>the body of page number {i}</p></div><article class=card>teaser</article></body>" for i in range(8)]
    assert texts(spark, pages) == [f"T{i} the body of page number {i}" for i in range(8)]
    assert texts(spark, pages[:1]) == ["our site T0 the body of page number 0 teaser"]


def test_names_are_whole(spark):
    article = "<article><h2 class=section-header>Head</h2><p class=share-price>Price</p><p>body</p></article>"
    for around in ("<div class='page no-sidebar'>%s</div>", "<div class='site header-fixed'>%s</div>", "<div class=menu>%s</div>", "<form id=page>%s</form>", "<div class=banner><form><div>%s</div></form></div>"):
        assert text_of(f"<body><nav>nav</nav>{around % article}<div class=site-footer>foot</div></body>") == "Head Price body"
    for name in ("sidebar", "site-header", "cookie-notice", "ad_2", "comments-area"):
        assert text_of(f"<body>{article}<div class={name}><p>part</p></div></body>") == text_of(f"<body><div><h2>Head</h2>Price<p>body</p></div><div id={name}><p>part</p></div></body>") == "Head Price body"
    assert text_of("<body><article><p>short</p></article><div class=related><article>one</article><article>two</article></div></body>") == "short"


def test_only_alignment_tells_menu_from_article(spark):
    # Class names say nothing and there is no article element; the constant parts of aligned pages are the template.
    page = "<body><div class=qa><div>Start</div><div>Contact us</div></div><div class=qb><h1>T%d</h1>%s</div><div class=qc><p>All prices without tax</p></div></body>"
    bodies = ["".join(f"<p>part {k} of text {i}</p>" for k in range(1 + i % 3)) for i in range(9)]
    assert texts(spark, [page % (i, b) for i, b in enumerate(bodies)]) == [f"T{i} " + " ".join(f"part {k} of text {i}" for k in range(1 + i % 3)) for i in range(9)]


def test_tree_matching_against_recursion(monkeypatch):
    import random

    def tree(r, depth=0):
        return (r.choice("abc"), [] if depth > 3 else [tree(r, depth + 1) for _ in range(r.randint(0, 4))])

    def text(t):
        return f"{t[0]} ( " + "".join(text(k) + " " for k in t[1]) + ")"

    def size(x, y):
        if x[0] != y[0]:
            return 0
        best = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, p in enumerate(x[1]):
            for j, q in enumerate(y[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(p, q))
        return 1 + best[-1][-1]

    # Whole tables, and lists of siblings that are halved.
    for cells in (H.MOST_CELLS, 4):
        monkeypatch.setattr(H, "MOST_CELLS", cells)
        H.align.cache_clear()
        for seed in range(150):
            r = random.Random(seed)
            x, y = (("r", [tree(r) for _ in range(r.randint(1, 5))]) for _ in range(2))
            found = H.align(text(x), text(y))
            assert len(found) == size(x, y) and [found[k] for k in sorted(found)] == sorted(found.values())


def test_pages_of_very_many_blocks_are_aligned():
    import random

    r = random.Random(1)
    x, y = ("r ( " + " ".join(r.choice(["h ( )", "p ( b ( ) )", "p ( )", "u ( l ( ) )"]) for _ in range(6000)) + " )" for _ in range(2))
    assert len(H.align(x, y)) > 6000


def test_cut_off_and_odd_tags_take_linear_time():
    import time

    many = " ".join(f'data-a{i}="v{i}" b{i}=\'w{i}\'' for i in range(500))
    head = "<body><article><p>kept</p>"
    pages = {
        f"{head}<div {many}": "kept",
        f"{head}<div {many} x=\"": "kept",
        f"{head}<div {'\"' * 501}": "kept",
        head + "<a " * 20_000: "kept",
        head + '<a x="' * 20_000: "kept",
        head + "<!" * 20_000: "kept",
        head + "<b " * 20_000 + ">end": "kept end",
        f"{head}<div {many} x=\">after</div>": "kept after",
        f"{head}1 < 2 and <3": "kept 1 < 2 and <3",
        f"{head}<p title=\"a > b\">quoted</p><p title=\"open>loose</p>": "kept quoted loose",
    }
    for page, wanted in pages.items():
        begin = time.perf_counter()
        found = text_of(page)
        assert (found, time.perf_counter() - begin < 0.5) == (wanted, True), page[:80]


def test_formulas_objects_and_headlines_are_text():
    page = "<body><header><h1>Site</h1></header><article><header><h1>Head</h1><nav>menu</nav></header><p>Let <math><mi>x</mi></math> be, <canvas>a drawing</canvas> <object>thing</object></p><xmp>as is</xmp><footer>foot</footer></article></body>"
    assert text_of(page) == "Head Let x be, a drawing thing as is"
