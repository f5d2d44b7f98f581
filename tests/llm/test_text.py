"""Decontamination against all windows, HTML extraction, and the pipeline."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from graspmeter.llm.decontam import contaminated, drop_contaminated
from graspmeter.llm.html_extract import main_texts
from graspmeter.llm.html_tree import parse
from graspmeter.llm.quality import keep_good
from graspmeter.llm.simhash_dedup import drop_near_copies
from graspmeter.llm.tree_match import Matcher, Tree, matched_texts


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_leaks(docs, items):
    found = {}
    for doc, text in docs:
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        for item, other in items:
            wanted = [w for w in re.split(r"[^\w]+|_", (other or "").lower()) if w]
            target = shingles(wanted)
            best = 0
            for start in range(max(1, len(words) - len(wanted) + 1)):
                window = shingles(words[start : start + len(wanted)])
                best = max(best, sum((window & target).values()) / max(1, sum((window | target).values())))
            if best >= 0.8:
                found[doc, item] = best
    return found


def test_leaks_equal_all_windows(spark, docs):
    pick = random.Random(8)
    text = lambda n: " ".join(pick.choice("abcdefghij") + pick.choice("klmnop") + str(pick.randrange(9)) for _ in range(n))
    items = [(i, text(pick.choice([5, 12, 30, 60]))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, ""), (53, "only four words here"), (54, "the same the same the same the same the same")]
    rows = [(100 + i, text(200)) for i in range(10)]
    for n, (i, item) in enumerate(items[:12]):
        words = item.split()
        rows.append((n, f"{text(40)}, {item.upper()}! {text(30)}"))
        rows.append((20 + n, f"{text(9)} {' '.join(words[: len(words) // 2])} {text(9)}"))
        if len(words) >= 60:
            words[2] = "changed"
            rows.append((40 + n, f"{text(20)} {' '.join(words)} {text(3)}"))
    rows += [(200, None), (201, ""), (202, "short"), (203, items[2][1]), (204, "The same, the same " * 5), (None, "x " + items[1][1]), (205, f"a {items[0][1]} b {items[1][1]}")]
    table = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    frame = docs(*rows, rows[-1])
    expected = brute_leaks(rows, items)
    found = {(r.doc_id, r.item_id): r for r in contaminated(frame, table).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k].similarity == pytest.approx(v) for k, v in expected.items())
    left = drop_contaminated(frame, table)
    leaking = {d for d, _ in expected}
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d for d, _ in rows} - leaking
    assert contaminated(docs().limit(0), table).count() == 0 and contaminated(frame, table.limit(0)).count() == 0


def test_blocks_of_odd_pages():
    page = """<header class="top"><h1>Site</h1></header><ul class="menu"><li><a href=x>A</a></ul><div id="cookie-notice">We bake</div>
    <main><h1>Head</h1><p>One <b>two</b>&nbsp;three<p>Four &lt;x&gt;<br>five<div class="comments"><article class=comment><p>nice</p></article></div>
    <ul><li>item<li>item <a href=y>two</a> more</ul><script>if(a<b){"</p>"}</script><!-- no --><form><p>mail</p></form></main><aside>s</aside><footer>f</footer>"""
    assert [t for t in parse(page).texts if t] == ["Head", "One two three", "Four <x> five", "item", "item two more"]
    assert parse(None).texts == parse("").texts == [] and parse("a < b <broken").texts == ["a < b <broken"]
    assert parse("<div>" * 5000 + "deep").texts == ["deep"]
    assert [t for t in parse("<article><header><h1>T</h1></header><p>x</article><p>out").texts if t] == ["T", "x"]


@pytest.mark.parametrize(
    "wrapper",
    [
        '<main class="content no-sidebar">{}</main>', '<div class="layout with-sidebar">{}</div>', '<article class="post comment-open">{}</article>',
        '<div class="page-notice-board">{}</div>', '<div class="hidden-print-x">{}</div>',
        '<form id="aspnetForm"><input type="hidden" name="state" value="x">{}</form>', '<form id="aspnetForm"><input name="q">{}</form>',
        '<div class="sidebar"><main>{}</main></div>', '<div id="menu-wrapper"><article>{}</article></div>', '<body class="modal">{}</body>',
        '<article><form><textarea></textarea><div>{}</div></form></article>',
    ],
)
def test_wrappers_hide_no_page(wrapper):
    text = "A story of some length that nobody would take for the label of a field. " * 6
    page = parse(wrapper.format(f"<p>{text}</p><p class='share-price'>It cost 7.</p>"))
    assert [t or a for t, a in zip(page.texts, page.around)] == [text.strip(), "It cost 7."]


@pytest.mark.parametrize(
    "region",
    [
        "<nav><article><p>{}</p></article></nav>", "<aside><article>{}</article></aside>", "<footer>{}</footer>", '<div class="site-footer">{}</div>',
        '<div id="cookieBanner">{}</div>', '<div class="ad-slot-2">{}</div>', '<ul class="main-nav"><li>{}</ul>', '<div class="post-comments">{}</div>',
        '<div role="navigation">{}</div>', '<form><input type="search"><label>{}</label></form>', '<div style="display: none">{}</div>', "<p hidden>{}</p>",
    ],
)
def test_regions_apart(region):
    page = parse(f"<div><p>The story is longer than the region.</p>{region.format('Not this')}</div>")
    assert [t for pair in zip(page.texts, page.around) for t in pair if t] == ["The story is longer than the region."]


def test_an_odd_first_page_does_not_hide_the_template(spark):
    """One page of the host in every pattern's place but its own: the others still tell what is constant."""
    def page(n):
        return f"<div><p>Read me first</p><div><p>Story {n} begins</p></div><p>All rights kept</p></div>"

    for odd in range(6):
        rows = [(n, "http://a.org/", "<table><tr><td>Error 500" if n == odd else page(n)) for n in range(40)]
        found = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert found == {n: "Error 500" if n == odd else f"Story {n} begins" for n in range(40)}


def brute_template(pages, share=0.8, least=3):
    """Texts that nearly all pages have at the place where one page of the host has them, by whole tables of matches."""
    parsed = [parse(page) for page in pages]
    everything = [list(page.everything) for page in parsed]
    constant = set()
    for pattern, texts in zip(parsed, everything):
        matched = [matched_texts(Tree(page.skeleton), Tree(pattern.skeleton), Matcher()) for page in parsed]
        others = [(pairs, own) for pairs, own in zip(matched, everything) if own != texts]
        for to, text in enumerate(texts):
            n = sum(any(j == to and own[i] == text for i, j in pairs) for pairs, own in others)
            if len(others) >= least and n >= share * len(others):
                constant.add(text)
    return constant


def test_texts_of_a_small_host_equal_brute_force(spark):
    pick = random.Random(12)
    fixed = ["Read me first", "All rights kept", "Follow us"]
    pages = []
    for n in range(9):
        story = "".join(f"<p>Part {n} {k}</p>" for k in range(pick.randrange(1, 5)))
        pages.append(f"<div><p>{fixed[0]}</p><div>{story}</div><p>{fixed[1]}</p><ul><li>{fixed[2]}</li></ul></div>")
    assert brute_template(pages) == set(fixed)
    rows = [(n, "http://a.org/", page) for n, page in enumerate(pages)]
    for row in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert row.text == "\n\n".join(t for t in parse(pages[row.page_id]).everything if t not in brute_template(pages))


def test_template_is_what_a_host_repeats(spark):
    def page(n):
        return f"<div><p>Read me first</p><div><p>Story {n} begins</p><p>and goes on {n * 7}</p></div><p>All rights kept</p></div>"

    rows = [(n, f"http://a.org/{n}", page(n)) for n in range(12)]
    rows += [(20 + n, "http://b.org/", page(99)) for n in range(6)] + [(30, None, page(1)), (31, "http://c.org", None), (32, "http://c.org", ""), (31, "http://c.org", None)]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, host int")
    found = main_texts(frame).collect()
    assert len(found) == len(rows)
    whole = lambda n: f"Read me first\n\nStory {n} begins\n\nand goes on {n * 7}\n\nAll rights kept"
    for row in found:
        expected = f"Story {row.page_id} begins\n\nand goes on {row.page_id * 7}" if row.page_id < 12 else whole(99) if row.page_id < 30 else whole(1) if row.page_id == 30 else ""
        assert (row.text, row.n_chars) == (expected, len(expected))
    assert main_texts(frame.limit(0)).count() == 0


def brute_match(a, b, i, j):
    """The recursion of simple tree matching over whole tables."""
    if a.labels[i] != b.labels[j]:
        return 0
    left, right = a.children[i], b.children[j]
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for x, c in enumerate(left):
        for y, d in enumerate(right):
            table[x + 1][y + 1] = max(table[x][y + 1], table[x + 1][y], table[x][y] + brute_match(a, b, c, d))
    return 1 + table[-1][-1]


def test_matching_is_the_largest(monkeypatch):
    pick = random.Random(9)

    def grow(depth):
        lines = []
        for _ in range(pick.randrange(1, 5)):
            if depth == 4 or pick.random() < 0.4:
                lines.append(f"{depth} #")
            else:
                lines += [f"{depth} {pick.choice(['p', 'div', 'ul'])}", *grow(depth + 1)]
        return lines

    for cells in (1 << 20, 4):
        monkeypatch.setattr("graspmeter.llm.tree_match.CELLS", cells)
        for _ in range(60):
            a, b = Tree("\n".join(grow(1))), Tree("\n".join(grow(1)))
            matcher = Matcher()
            pairs = matched_texts(a, b, matcher)
            assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) and pairs == sorted(pairs, key=lambda p: p[1])
            assert matcher.weight(matcher.shape_of(a)[0], matcher.shape_of(b)[0]) == brute_match(a, b, 0, 0)


def test_stages_judge_rows_and_not_ids(spark, docs):
    """Rows without id, rows that share one, repeated rows and columns of clashing names."""
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    rows = [(None, f"before {item} after"), (None, "clean words only"), (7, item), (7, "clean words of the same id"), (8, None), (8, "")]
    left = drop_contaminated(docs(*rows), benchmark)
    assert left.columns == docs().columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(None, "clean words only"), (7, "clean words of the same id"), (8, None), (8, "")]))
    assert drop_contaminated(docs().limit(0), benchmark).count() == 0 and drop_contaminated(docs(*rows), benchmark.limit(0)).count() == 6

    near = "the quick brown fox jumps over the lazy dog and runs far away from all of it " * 40
    rows = [(None, near), (None, near + "now"), (5, near), (5, near), (5, near + "then"), (6, "other words"), (None, "lone words without id"), (None, "lone words without id")]
    kept = drop_near_copies(docs(*rows))
    assert kept.columns == docs().columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == 3 and {i for i, t in found if t.startswith("the quick")} == {5} and (None, "lone words without id") in found
    assert drop_near_copies(docs().limit(0)).count() == 0

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "fine words here" if i % 2 else "BAD!! ###") for i in range(60)] + [(None, "BAD!! ###"), (None, "fine words here"), (3, "BAD!! ###")]
    good = [(r.doc_id, r.text) for r in keep_good(docs(*rows), labels).collect()]
    assert sorted(map(str, good)) == sorted(map(str, [*((i, "fine words here") for i in range(1, 60, 2)), (None, "fine words here")]))
    assert keep_good(docs().limit(0), labels).count() == 0


def test_pipeline_takes_each_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, sf)
        seen.append(left.count())
        if name != "mixing":
            assert left.columns == docs.columns and left.subtract(docs).count() == 0
            docs = left
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[2] < seen[1]
    assert sorted(map(str, left.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_text_around_an_article_and_lists_of_links_are_content(spark):
    links = "<ul><li><a href=r>Reference</a></ul><table><tr><td><a href=c>Cell</a></table>"
    sources = [
        f"<article><p>Story</p>{links}</article>", "<main><h1>Title</h1><p>Lead</p><article><p>Story</p></article></main>",
        "<div><article><p>Teaser</p></article></div><main><p>Long text</p></main><div>More</div>", "<ul><li><a href=m>Menu</a></ul><p>Story</p>",
    ]
    rows = [(n, f"http://h{n}.org/", source) for n, source in enumerate(sources)]
    found = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.split("\n\n") for r in found} == {
        0: ["Story", "Reference", "Cell"], 1: ["Title", "Lead", "Story"], 2: ["Teaser", "Long text", "More"], 3: ["Story"],
    }
