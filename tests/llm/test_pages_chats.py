"""Web pages, URLs and transcripts."""

import random
import time

import numpy as np
import pytest

from epiwave.llm import chat_format, html_extract, url_filter

# ---- HTML ----


def page(k: int, paragraphs: list[str], extra: str = "") -> str:
    nav = "".join(f"<li><a href='/{k}{j}'>Link {k * 7 + j}</a></li>" for j in range(k % 4 + 1))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{x:'</p>'}}</style><script>var a='<p>no</p>';</script></head><body>"
        f"<nav><ul>{nav}</ul></nav><!-- <p>hidden {k}</p> --><div class='cookie-notice'>Notice {k}</div><div class=\"top ad\">Advert {k}</div>"
        f"<div class='wrap'><div class='story'><h1>Head {k}</h1>{body}{extra}<p>Subscribe to our paper today.</p></div>"
        f"<div class='comments'><p>First! {k}</p></div><aside>Other {k}</aside><form><input value='x'>Send {k}</form></div>"
        f"<footer>&copy; Site {k}</footer></body></html>"
    )


def test_template_wording_and_slots(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(14):
        own = [f"Text {k} {j} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) for j in range(k % 3 + 1)]
        rows.append((k, f"http://a.example.net/{k}", page(k, own, f"<p>Fish {k} &amp; chips &#233; <b>bold</b>\n text<br>next"), 1, "x"))
        want[k] = "\n\n".join([f"Head {k}", *own, f"Fish {k} & chips é bold text next"])
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, page int, host string")).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and "\n\n".join(r.blocks) == r.text for r in got.values())


def test_pages_of_small_hosts_and_odd_input(spark):
    rows = [
        (1, "http://b.example.net/1", "<article><h1>A</h1><p>one<p>two <b>b<div class=comments>no</div></article><p>out</p>"),
        (2, None, None), (3, "no scheme", ""), (4, "http://c.example.net", "plain text < 3 &lt;b&gt;"), (5, "http://c.example.net", "<p>cut off <scr"),
        (6, "http://c.example.net", "<main><p>a</p></p></div><p>b</main>"), (6, "http://c.example.net", "<main><p>a</p></p></div><p>b</main>"),
        (None, "http://c.example.net", "<p>x</p><script>never closed <p>y</p>"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.text) for r in html_extract.extract(table).collect()))
    assert got == [(0, "x"), (1, "A\n\none\n\ntwo b"), (2, ""), (3, ""), (4, "plain text < 3 <b>"), (5, "cut off <scr"), (6, "a\n\nb"), (6, "a\n\nb")]
    assert html_extract.extract(table.limit(0)).count() == 0


def texts_of(spark, pages: list[str]) -> list[str]:
    rows = [(k, f"http://d.example.net/{k}", p) for k, p in enumerate(pages)]
    return [r.text for r in sorted(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_names_of_containers_that_hold_the_text(spark):
    body = "<p>A long first paragraph of the page's own text.</p><p>And a second one, as long as that.</p>"
    want = "A long first paragraph of the page's own text.\n\nAnd a second one, as long as that."
    whole = [
        f'<body class="no-sidebar"><div>{body}</div></body>', f'<article class="post has-comments">{body}</article>', f'<div class="content tags-python">{body}</div>',
        f'<div id="main-search-results">{body}</div>', f'<html class="widget"><body id="top" class="search"><main role="search">{body}</main></body></html>',
        f'<div class="widget">{body}</div><p class="ad">Buy</p>', f'<div class="w-1/2 share">{body}</div>',
    ]
    aside = [
        f'<article>{body}</article><div class="comments">{"<p>A long comment on it.</p>" * 20}</div>', f'{body}<div class="cookie-notice">We bake</div><div class="box share-buttons">Share</div>',
        f'<div class="story">{body}</div><div id="comment-12"><p>First!</p></div><nav>{"Menu " * 90}</nav>',
    ]
    assert texts_of(spark, whole + aside) == [want] * 10


def test_copies_and_common_wording_stay_in_articles(spark):
    frame = lambda k, inner: f"<body><div class='top'><p>All our news</p></div>{inner}<div class='foot'><p>Call us at once, {k}</p></div></body>"
    copies = [frame(0, "<article><h1>Rain</h1><p>It rained all day, and then it rained all night.</p></article>")] * 12 + [frame(k, f"<article><h1>Sun {k}</h1><p>Dry and warm in all of the country, {k}</p></article>") for k in (1, 2)]
    assert texts_of(spark, copies) == ["Rain\n\nIt rained all day, and then it rained all night."] * 12 + [f"Sun {k}\n\nDry and warm in all of the country, {k}" for k in (1, 2)]
    headed = [frame(k, f"<article><p>Text {k} of ours</p><h2>References</h2><p>Book {k}</p></article>") for k in range(10)]
    assert texts_of(spark, headed) == [f"Text {k} of ours\n\nReferences\n\nBook {k}" for k in range(10)]
    # Without an article, the wording of many copies of one page is no template either.
    plain = [frame(0, "<div class='story'><p>It rained all day, and then it rained all night.</p></div>")] * 12 + [frame(1, "<div class='story'><p>It was dry all day.</p></div>")]
    assert all("rained all day" in t for t in texts_of(spark, plain)[:12])
    assert all("All our news" not in t for t in texts_of(spark, [frame(k, f"<div class='story'><p>Story {k} of the day</p></div>") for k in range(9)]))


def test_articles_are_taken_where_they_hold_the_text(spark):
    body = "<h1>Rivers</h1>" + "<p>Rivers rise in hills and end in seas.</p>" * 4
    want = "\n\n".join(["Rivers", *["Rivers rise in hills and end in seas."] * 4])
    teasers = "<div class='cards'>" + "".join(f"<article><h2>Card {k}</h2></article>" for k in range(3)) + "</div>"
    pages = [
        f"<body><main>{body}{teasers}</main></body>", f"<body>{teasers}<main>{body}</main></body>", f"<main><article>{body}</article><p>More</p></main>", f"<p>Hello</p><article>{body}</article>",
        f"<div class='story'>{body}</div>{teasers}", f"<article><main>{body}</main></article>", f"<main>{teasers}</main>",
    ]
    cards = "Card 0\n\nCard 1\n\nCard 2"
    assert texts_of(spark, pages) == [f"{want}\n\n{cards}", want, want, want, f"{want}\n\n{cards}", want, cards]


# ---- URLs ----


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:stop]


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.example.ORG/es/1?x#y", "https://example.org/en/1", "https://notexample.org/en/1", "http://x.com/fr/2", "http://x.com/de/", "http://com/de/3", "ftp://x.net?a/b",
            "HTTP://É.net#/f", "no scheme", "", None, "http://", "://only", "http://org", "a://b://c/d", "http://x.com/" + "q" * 20_000, "http://x.com/de/", "http://x.com\n/de/"]
    rows = [(k, u, "h", "p") for k, u in enumerate(urls)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    model = url_filter.train_url_model(url_filter.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judge_urls(table, model).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = parts_of(u)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == (verdict or got[k].verdict) and got[k].verdict in ("allow", "block")
    assert url_filter.judge_urls(table.limit(0), model).count() == 0


def test_url_model_on_urls_it_has_not_seen(spark):
    block = ["http://www.best-casino.example.net/free-spins", "https://ads.track.example.net/click?x=2", "http://adult-xxx.example.com/clip", "https://shop.example.net/cart/login", "http://torrent.example.net/download/keygen"]
    allow = ["http://m.example.net/en/991", "https://wiki.example.net/article/history-of-paper", "http://blog.example.com/2021/07/notes-on-rivers", "https://docs.example.com/guide/functions", "http://www.example.net/es/7001"]
    table = spark.createDataFrame(list(enumerate(block + allow)), "page_id long, url string")
    labelled = url_filter.labelled_urls(spark)
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(table, url_filter.train_url_model(labelled), rules=()).collect()}
    hits = sum(got[k] == ("block" if k < len(block) else "allow") for k in got)
    assert hits >= 9
    plan = url_filter.judge_urls(table, url_filter.train_url_model(labelled))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- chats ----


def plain_path(rows, model):
    """Viterbi over all lines of one conversation at once."""
    s = chat_format.Scores(model)
    best, back, lines = None, [], []
    for role, text in rows:
        for k, (written, rest, markers) in enumerate(chat_format.lines_of(role, text)):
            seen = s.seen(rest, markers)
            if best is None:
                best = s.turn[chat_format.BEGIN] + seen
            else:
                step = s.turn[: chat_format.BEGIN] if k == 0 else s.change if written else s.line
                step = step[: chat_format.BEGIN]
                scores = best[:, None] + step
                back.append(scores.argmax(axis=0))
                best = scores.max(axis=0) + seen
            lines.append(rest)
    states = [int(np.argmax(best))]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return [chat_format.ROLES[k] for k in reversed(states)], lines, float(best.max())


TEXTS = ["How do I do it?", "Sure, here is how.\nFirst do this.\n```\ncode\n```", "User: what is it\nAssistant: It is this.", "You are a kind helper.", "{\"result\": 3}", "Please write more", "", None,
         "**Human:** hello\n### Response: hello to you", "ok", "A: an answer", "plain words that say little at all"]


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_chunks_give_the_best_path(spark, chunk):
    rng = random.Random(chunk)
    convs = {c: [(t, rng.choice(["user", "assistant", "system", None, "Bot", "odd"]), rng.choice(TEXTS)) for t in range(rng.choice([1, 2, 5, 30]))] for c in range(12)}
    rows = [(c, t, r, x, 1, 2) for c, turns in convs.items() for t, r, x in turns]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c long, m long").repartition(3)
    got = {}
    for r in chat_format.format_chats(table, chunk=chunk).collect():
        got.setdefault(r.conv_id, []).append(r)
    s = chat_format.Scores(chat_format.RoleModel())
    for c, turns in convs.items():
        parts = sorted(got[c], key=lambda r: (r.turn, r.part))
        roles = [r.role for r in parts for _ in range(r.n_lines)]
        want, lines, score = plain_path([(r, x) for _, r, x in turns], chat_format.RoleModel())
        assert len(roles) == len(want)
        if roles != want:  # another path of the same score
            total, before, at = 0.0, None, 0
            for role, text in [(r, x) for _, r, x in turns]:
                for k, (written, rest, markers) in enumerate(chat_format.lines_of(role, text)):
                    now = chat_format.ROLES.index(roles[at])
                    table_ = s.turn if k == 0 else s.change if written else s.line
                    total += table_[chat_format.BEGIN if before is None else before][now] + s.seen(rest, markers)[now]
                    before, at = now, at + 1
            assert total == pytest.approx(score)
        for r in parts:
            assert r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>")


def test_markers_speakers_and_odd_rows(spark):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "Hello."), (2, 0, None, "User: what is it?\nAssistant: It is this.\nMore of it."), (3, None, None, None), (3, 4, "user", "x"), (None, 1, "user", "q?"),
            (None, 1, "user", "q?"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(table).collect()
    by = lambda c: [(r.turn, r.part, r.role, r.n_lines, r.rendered) for r in sorted((r for r in got if r.conv_id == c), key=lambda r: (-1 if r.turn is None else r.turn, r.part))]
    assert [(x[2], x[4]) for x in by(1)] == [("user", "<|user|>\nHi?\n<|end|>"), ("assistant", "<|assistant|>\nHello.\n<|end|>")]
    assert [(x[1], x[2], x[3]) for x in by(2)] == [(0, "user", 1), (1, "assistant", 2)]
    assert by(2)[1][4] == "<|assistant|>\nIt is this.\nMore of it.\n<|end|>"
    assert len(by(3)) == 2 and by(3)[1][2] == "user"
    assert len(by(None)) == 2 and len(by(4)) == 2
    assert chat_format.format_chats(table.limit(0)).count() == 0


@pytest.mark.parametrize("form", ["<div ", '<a href="', "<button>", "<svg>", "<div>", "</p>", "<!--", "<script>", '<b ">" ', "<p '", "<li><p>", "<", "<br"])
def test_a_long_broken_page_is_read_in_time(form):
    page = form * (1_000_000 // len(form))
    for tail in ("", ">", "'>"):
        begun = time.process_time()
        found = list(html_extract.blocks(f"before {page}{tail}"))
        assert time.process_time() - begun < 20
        assert found[0] == ("", "before") or found[0][1].startswith("before")
        assert all(p.count("/") < html_extract.DEEPEST for p, _ in found)


def test_tags_of_broken_pages():
    kinds = lambda page: [(k, n) for _, _, k, n, _ in html_extract.Tags(page)]
    assert kinds("<p class='a>b'>x</P ><svg/><svg>in</svg><script>if (a<b)") == [("open", "p"), ("close", "p"), ("open", "svg"), ("gap", "svg"), ("gap", "script")]
    assert kinds("a < b <- c <p 'open>x<!-- never") == [("other", ""), ("other", "")]
    assert [t for _, t in html_extract.blocks("1 < 2<p>x<p/>&amp;</q><button>ok<h1>y") if t] == ["1 < 2", "x", "&ok", "y"]


def test_hosts_of_two_pages_have_a_template(spark):
    page = "<html><body><div><p>Menu of all pages here</p></div><div><p>{}</p></div></body></html>"
    bodies = ["First text that stands on one page of the host alone.", "Second text that stands on another page of the same host."]
    rows = [(k, f"http://a.example/{k}", page.format(b)) for k, b in enumerate(bodies)] + [(9, "http://b.example/", page.format(bodies[0]))]
    near = "<html><body><p>The same long text on both pages of this host.</p><p>{}</p></body></html>"
    rows += [(20 + k, f"http://c.example/{k}", near.format(k)) for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == bodies[0] and got[1] == bodies[1] and got[9].startswith("Menu of all pages here")
    assert got[20].startswith("The same long text")


def test_repeated_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 1, None, "plain words")] * 40 + [(None, None, None, None)] * 3 + [(0, 1, None, "plain words")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert {r.role for r in got if r.turn == 1} == {"user"} and len({r.role for r in got if r.turn is None}) == 1


def test_chunks_are_small_whatever_the_turns(spark, monkeypatch):
    rows = [(1, None, "user", f"null {k}") for k in range(300)] + [(2, 7, "user", f"same {k}") for k in range(300)] + [(3, 5, "user", "equal")] * 300
    sizes = []
    combined = chat_format.combined

    def counted(df, chunk, order):
        sizes.append(df.groupBy(*chat_format.GROUP, chunk).count().agg({"count": "max"}).first()[0])
        return combined(df, chunk, order)

    monkeypatch.setattr(chat_format, "combined", counted)
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=64).collect()
    assert sizes[0] == 64 and max(sizes) <= 64
    assert sorted((r.conv_id, r.rendered) for r in got) == sorted((c, f"<|user|>\n{x}\n<|end|>") for c, _, _, x in rows)
