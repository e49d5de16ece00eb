"""Repeats on pages without article markup, on small and large hosts."""

import random

from feedlake.llm import html


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}


def test_large_hosts_give_what_small_ones_give(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    notice, menu = (" ".join(f"{n}{k}" for k in range(40)) for n in ("notice", "menu"))
    for i in range(30):
        own = " ".join(f"p{i}w{rng.randrange(10**6)}" for _ in range(50))
        rows.append((i, f"http://h/{i}", f"<p>{own}</p>" + f"<div>{notice}</div>" * (i in (3, 17, 22)) + f"<div>{menu} end</div>" * (i % 2)))
    rows += [(40, "http://other/", f"<p>{menu}</p>"), (41, None, f"<p>{notice}</p>"), (3, *rows[3][1:]), (42, "http://h/e", "")]
    small = texts(spark, rows)
    monkeypatch.setattr(html, "GROUP_CHARS", 1_500)
    large = texts(spark, rows)
    assert large == small
    assert not any("notice" in large[i] or "menu" in large[i] for i in range(30)) and len(large[3].split()) == 50
    assert "menu39" in large[40] and "notice0" in large[41] and large[42] == ""


def test_phrases_inside_prose_stay(spark, monkeypatch):
    rng = random.Random(6)
    phrases = ["at the end of the day", "one of the most important things", "as far as I know it is"]
    rows, prose = [], {}
    for i in range(40):
        word = lambda: f"w{rng.randrange(10**6)}"
        prose[i] = " ".join(f"{word()} {word()} {p} {word()}." for p in rng.sample(phrases, 2) for _ in range(3))
        menu = "".join(f"<li>{w}" for w in ("Home", "News", "Shop", "About", "Contact"))
        rows.append((i, f"http://h/{i}", f"<div><ul>{menu}</ul></div><p>{prose[i]}</p>" + "<div>Closed on Sunday and Monday until the end of the month</div>" * (i < 3) + "<p>Shared by two pages only</p>" * (i < 2)))
    want = {i: prose[i] + " Shared by two pages only" * (i < 2) for i in prose}
    assert texts(spark, rows) == want
    monkeypatch.setattr(html, "GROUP_CHARS", 1_000)
    assert texts(spark, rows) == want


def test_short_blocks_need_a_share_of_the_host():
    assert [html.least_pages(5, n) for n in (1, 2, 3, 6, 10_000)] == [2, 2, 3, 3, 100]
    assert html.least_pages(12, 10_000) == 3


def test_class_marks_spare_main_elements_and_flags():
    for tag in ("article class='post comments-open'", "article class='hentry category-social'", "main class='has-sidebar'", "div role=main class='menu'"):
        assert html.page_blocks(f"<div>x</div><{tag}><p>all of it</p></{tag.split()[0]}>") == (["all of it"], True)
    for name in ("no-sidebar", "content comments-closed", "sidebar-right", "category-social", "ad-free"):
        assert html.page_blocks(f"<div id='content' class='{name}'>kept</div>") == (["kept"], False)
    for name in ("ad", "box ads", "cookie-notice", "adBox", "site-header", "sidebar", "comments"):
        assert html.page_blocks(f"<div class='{name}'>gone</div><p>kept</p>") == (["kept"], False)
    assert html.page_blocks("<article hidden>no</article><article>yes</article>") == (["yes"], True)


def test_pages_without_main_blocks_reach_the_suffix_array(spark):
    menu = " ".join(f"item{k}" for k in range(12))
    rows = [(i, f"http://h/{i}", f"<!-- <article> --><script>'<main>'</script><div>{menu}</div><p>own{i} text{i}</p>") for i in range(4)]
    rows.append((9, "http://h/9", f"<article class='post comments-open'>{menu}</article>"))
    assert texts(spark, rows) == {i: f"own{i} text{i}" for i in range(4)} | {9: menu}


def kept(page):
    blocks, kinds = html.read_page(page)
    return " ".join(b for b, k in zip(blocks, kinds) if k >= html.OPEN)


def test_attributes_are_read_one_by_one():
    assert kept('<article><p>see <a href="/tags/hidden-falls">the falls</a> now</p></article>') == "see the falls now"
    assert kept('<p title="hidden gems of Rome">Main para</p><p data-hidden="no">a</p><a href="/p?id=share">b</a>') == "Main para a b"
    assert kept("<p CLASS=ad>x</p><p id='comments'>y</p><p style='color:red;display : none'>z</p><p hidden=''>w</p><p aria-hidden=\"true\">v</p>t") == "t"


def test_closing_an_inline_element_restores_what_was_before():
    assert kept("<article><p>one <span class=ad>buy</span> two <b>three</b> four</p></article>") == "one two three four"
    assert kept("<p>a <span hidden>b <i>c</i></span>d</p>") == "a d"
    assert kept("<p>one<b>two</b>three</p>") == "onetwothree"


def test_an_article_without_text_is_none():
    assert kept("<main><article></article><p>text of main</p></main>") == "text of main"
    assert kept("<article> </article><p>text</p>") == "text"


def test_cut_off_and_long_pages():
    assert kept("<article><p>a<b>b</article><p>c") == "ab"
    assert kept("<p>x</p><!-- never closed <p>y</p>") == "x"
    assert kept("<p>x <a href='") == "x"
    assert len(kept("<div>" * 3_000 + "<p>deep words</p>" * 20_000).split()) == 40_000


def test_suspects_in_articles_go_only_if_they_repeat(spark, monkeypatch):
    share = "<div class='share-box'>Share it with all your friends today</div>"
    rows = [(i, f"http://h/{i}", f"<nav>menu of the site</nav><article><p>own{i} words{i}</p><div class='share-price'>cost {i} per share now</div>{share}<p>the same quote in every article</p></article>") for i in range(5)]
    rows += [(9, "http://other/", f"<article>alone{share}</article>"), (10, "http://h/x", "<div>menu of the site</div><p>bare page of its own</p>"), (11, "http://h/y", "")]
    want = {i: f"own{i} words{i} cost {i} per share now the same quote in every article" for i in range(5)}
    want |= {9: "alone Share it with all your friends today", 10: "bare page of its own", 11: ""}
    assert texts(spark, rows) == want
    monkeypatch.setattr(html, "GROUP_CHARS", 0)
    assert texts(spark, rows) == want


def brute(pages, long):
    """Open tokens that no window of ``long`` tokens shared with another page covers."""
    seen = {}
    for i, streams in pages.items():
        for words in streams:
            for s in range(len(words) - long + 1):
                seen.setdefault(tuple(words[s : s + long]), set()).add(i)
    out = {}
    for i, (words, _) in pages.items():
        gone = [False] * len(words)
        for s in range(len(words) - long + 1):
            if len(seen[tuple(words[s : s + long])]) > 1:
                gone[s : s + long] = [True] * long
        out[i] = " ".join(w for w, g in zip(words, gone) if not g)
    return out


def test_long_repeats_match_brute_force_on_small_and_large_hosts(spark, monkeypatch):
    rng = random.Random(11)
    passages = [[f"p{k}w{rng.randrange(9)}" for _ in range(n)] for k, n in enumerate((14, 29, 30, 31, 45, 80))]
    rows, pages = [], {}
    for i in range(30):
        streams = []
        for _ in range(2):
            words = []
            for _ in range(4):
                words += rng.choice(passages) if rng.random() < 0.4 else [f"u{rng.randrange(4)}" for _ in range(12)]
            streams.append(words)
        rows.append((i, f"http://h/{i}", f"<div>{' '.join(streams[0])}</div><nav>{' '.join(streams[1])}</nav>"))
        pages[i] = streams
    want = brute(pages, html.LONG)
    assert any(want.values()) and want != {i: ' '.join(s[0]) for i, s in pages.items()}
    assert texts(spark, rows) == want
    monkeypatch.setattr(html, "GROUP_CHARS", 0)
    assert texts(spark, rows) == want


def test_null_urls_and_clashing_columns(spark):
    rows = [(i, None, f"<p>page {i}</p><div>{'the same words on all pages here ' * 6}</div>", "x", "y") for i in range(3)] + [(None, "http://h/", None, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string, kinds string")
    assert sorted(r["text"] for r in html.extract_text(df).collect()) == ["", "page 0", "page 1", "page 2"]


def test_comments_and_adverts_with_own_text_go_by_their_containers(spark, monkeypatch):
    """Unlike text in containers that other pages have in the same place; one that a single page has is its own."""
    bodies = {
        "comment-list": "<ul class='comment-list'><li id='comment-{i}'>I disagree, says Bob number {i}</li></ul>", "ad-slot": "<div class='ad-slot'>Buy the thing {i} now</div>",
        "cookie-notice": "<div class='cookie-notice'>We set {i} cookies</div>", "reader-comments": "<section class='reader-comments'><p>Nice read {i}</p><p>Not mine {i}</p></section>",
        "user-comments": "<div id='user-comments-{i}'>User {i} wrote this</div>", "google-ad": "<div class='box google-ad'>Offer number {i}</div>",
    }
    rows, whole = [], {}
    for base, (shape, (name, body)) in enumerate((x, y) for x in ("<article><p>own{i} text{i}</p>{body}</article>", "<div><p>own{i} text{i}</p>{body}</div>") for y in bodies.items()):
        host = f"{base}.example"
        page = lambda i: shape.format(i=i, body=body.format(i=i))  # noqa: B023, E731
        rows += [(100 * base + i, f"http://h{host}/{i}", page(i)) for i in range(3)] + [(100 * base + 9, f"http://alone{host}/", page(9))]
        rows += [(100 * base + 7, f"http://other{host}/7", page(7))] + [(100 * base + k, f"http://other{host}/{k}", f"<article><p>own{k} text{k}</p></article>") for k in (20, 21)]
        whole[100 * base + 7] = "<article>" in shape
    for limit in (html.GROUP_CHARS, 0):
        monkeypatch.setattr(html, "GROUP_CHARS", limit)
        found = texts(spark, rows)
        for i, text in found.items():
            k = i % 100
            if k != 7:
                assert text == f"own{k} text{k}", i
            elif whole[i]:  # no other page has its container
                assert text != "own7 text7" and text.startswith("own7 text7"), i


def test_paragraphs_and_headings_keep_names_of_content():
    page = "<article><p class='related'>A related finding</p><p class='social'>Social history of X</p><h2 class='banner'>Banner year for wheat</h2><div class='related'>More to read</div><p class='ad'>buy</p></article>"
    assert kept(page) == "A related finding Social history of X Banner year for wheat"
    for name in ("no-ads", "ad-free", "comments-open", "cookie-recipe", "commentary", "has-comments", "without-comments-here"):
        assert kept(f"<article><p>a</p><div class='{name}'>b</div></article>") == ("a b" if name != "cookie-recipe" else "a"), name


def test_forms_go_by_their_fields():
    words = "a page of many words " * 20
    assert kept(f"<form action='/x'><input type=hidden name=s><p>{words}</p><input name=q><button>Go</button></form>") == words.strip()
    assert kept("<p>x</p><form>Your name <input> your mail <input><textarea>t</textarea><button>Send it</button></form><p>y</p>") == "x y"
    assert kept(f"<form><article><p>{words}</p><form>Mail <input></form></article></form>") == words.strip()
    assert kept("<article><form>Ask us <select><option>a</select></form></article><p>text</p>") == "text"


def test_pages_against_a_tree():
    """``read_page`` on random well-formed pages against a tree walk."""
    rng = random.Random(9)
    inline, block, gone = ("b", "span", "a"), ("div", "p", "ul", "section", "h2"), ("nav", "footer", "aside")

    def tree(depth):
        kind = rng.choice(("text", "text", "inline", "block", "gone")) if depth else "text"
        if kind == "text":
            return " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 4)))
        names = {"inline": inline, "block": block, "gone": gone}[kind]
        return rng.choice(names), [tree(depth - 1) for _ in range(rng.randrange(1, 4))]

    def source(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(source, node[1]))}</{node[0]}>"

    def inner(node):
        """All elements below a node."""
        return [] if isinstance(node, str) else [x for c in node[1] if not isinstance(c, str) for x in (c, *inner(c))]

    def walk(node):
        """Text with line ends around blocks; nothing of what goes."""
        if isinstance(node, str):
            return node
        text = "" if node[0] in gone else "".join(map(walk, node[1]))
        return text if node[0] in inline else f"\n{text}\n"

    # inside a phrase or paragraph a block would end it, which is tested on its own
    plain = lambda node: not any(x[0] in (*inline, "p", "h2") and any(y[0] not in inline for y in inner(x)) for x in (node, *inner(node)) if not isinstance(x, str))
    tried = 0
    for _ in range(2_000):
        nodes = [tree(4) for _ in range(3)]
        if not all(map(plain, nodes)):
            continue
        tried += 1
        want = [" ".join(b.split()) for b in "".join(map(walk, nodes)).split("\n") if b.split()]
        assert [b for b, k in zip(*html.read_page("".join(map(source, nodes)))) if k] == want
    assert tried > 300
