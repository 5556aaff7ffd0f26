"""Parts without Spark: perfect hashing, Elias-Fano, BPE pieces, bucket ends, schedules, signatures, HTML."""

import itertools

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import elias_fano, html_text, minhash, mixing, packing
from graphloom.llm.bpe import Encoder
from graphloom.llm.mphf import Lookup, build

BPE = Encoder(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_a_bijection(keys):
    a = np.array(sorted(keys), dtype=np.uint64)
    found = Lookup(build(a))
    assert sorted(found.index(a).tolist()) == list(range(len(a))) and len(found) == len(a)


@settings(max_examples=50, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 10**9), max_size=1500), st.lists(st.integers(0, 2**63 - 1), max_size=40)))
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, dtype=np.int64))
    reader = elias_fano.Reader(**elias_fano.encode(v))
    assert reader.range(0, len(v)).tolist() == v.tolist()
    for i in range(0, len(v), 97):
        assert reader.select(i) == v[i]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85 aéZ1中🙂'.,!<|>st"), max_size=40))
def test_pieces_give_the_ids_of_the_whole(text):
    assert np.frombuffer(BPE.encode(text), BPE.dtype).tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "'s", "'", "\\", "\U000323b0", "\U0001e6c0", "\u180e", "\u200b", "\u2028", "A", "1"])), max_size=12).map("".join))
def test_pieces_over_all_of_unicode(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(BPE.encode(text), BPE.dtype).tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_go_to_the_library_whole():
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Some  WORDS of a text\n\nand more", "", " a", "Ünïcode's 123"):
        assert not other.cut and np.frombuffer(other.encode(text), other.dtype).tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


def test_the_case_of_an_unassigned_character():
    text = "\\\U000323b0'sA"
    assert np.frombuffer(BPE.encode(text), BPE.dtype).tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text():
    text = "a<|endoftext|> b"
    assert np.frombuffer(BPE.encode(text), BPE.dtype).tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids
    plain = Encoder(public_tokenizers.path("byte_bpe_50k.json"), special_as_text=True)
    assert 50256 not in np.frombuffer(plain.encode(text), plain.dtype)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(1, 5))
def test_bucket_ends_are_optimal(hist, buckets):
    lengths = np.array(sorted(hist))
    n = np.array([hist[x] for x in lengths])

    def padding(ends):
        return sum((min(e for e in ends if e >= x) - x) * k for x, k in zip(lengths, n, strict=True))

    best = min(padding({*c, lengths[-1]}) for r in range(buckets) for c in itertools.combinations(lengths[:-1], r))
    ends = packing.bucket_ends(lengths, n, lengths * n, buckets)
    assert padding(ends) == best and len(ends) <= buckets


@given(st.lists(st.floats(0, 5), min_size=2, max_size=5).filter(lambda w: sum(w) > 0.1), st.floats(0, 1))
def test_time_of_demand_inverts_the_integral(weights, share):
    schedule = [(i / (len(weights) - 1), w) for i, w in enumerate(weights)]
    t = float(mixing.time_of_demand(schedule, np.array([share]))[0])
    grid = np.linspace(0, t, 4001)
    met = np.trapezoid(np.interp(grid, *zip(*schedule, strict=True)), grid)
    assert abs(met - share * mixing.mean_weight(schedule)) < 2e-3


def test_extra_documents_follow_their_share():
    rng = np.random.default_rng(0)
    sizes = np.unique(rng.integers(1, 5000, 60))
    n = rng.integers(1, 9, len(sizes))
    more = mixing.extra_by_size(sizes, n, 0.37)
    assert (more <= n).all() and abs((more * sizes).sum() - 0.37 * (sizes * n).sum()) <= sizes.min()


def test_signatures_within_the_threshold_share_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, minhash.POSITIONS).astype(np.uint8)
    for _ in range(200):
        other = base.copy()
        at = rng.choice(minhash.POSITIONS, minhash.THRESHOLD, replace=False)
        other[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
        a, b = minhash.index_keys(np.stack([base, other]))
        assert (a == b).any()


def test_shingles():
    s = minhash.Shingler(4)
    assert len(s.sets(b"")) == 0 and len(s.sets(b" \t\n")) == 0 and len(s.sets(b"A b")) == 1
    assert s.sets(b"A  B\tc d e").tolist() == s.sets(b"a b c d E").tolist() and len(s.sets(b"a b c d e")) == 2
    assert len(s.sets(b"x " * 100)) == 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice"><p>We use the cookies that are needed for the site to work in the way it was made to work, and that is all there is to say of it.</p></div>
<article><h1>Title &amp; more</h1><p>Short<br>line.<p>The first of the long paragraphs of the article, which is about the town by the river and the people who live in it &lt;now&gt;.
<script>var x = "</p><p>no";</script></p><aside>Related</aside><p>zzz%%% qqq*** ppp###</p></article>
<form><p>Search the site for the things that you want.</p></form><div id="comments"><p>I think that this is the best of all the articles that I have read on the site.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_an_article():
    blocks = html_text.main_text(PAGE).split("\n\n")
    assert blocks == ["Title & more", "Short line.", "The first of the long paragraphs of the article, which is about the town by the river and the people who live in it <now>.", "zzz%%% qqq*** ppp###"]


def test_main_text_without_article_marks():
    long = "This is one of the long paragraphs that the page has for the reader, and it is about the history of the town by the river, " * 2
    page = f"<body><div><a href=x>Home</a> <a href=y>More</a></div><div><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=z>Next page of the site</a></div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Head", long.strip(), "Short.", long.strip()]


def test_main_text_of_broken_pages():
    assert html_text.main_text("") == "" and html_text.main_text("<") == "" and html_text.main_text("<article><p>&am") == "&am"
    assert html_text.main_text("<article><p a='x>y'>ok</p><p <b>z") is not None
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_main_text_beside_scripts_with_less_than():
    loop = "<script>for(i=0;i<n;i++){x()}</script>"
    assert html_text.main_text(f"<body>{loop}<article><p>Before.</p>{loop}<p>After.</p><SCRIPT>if(a<b){{s='<p'}}</Script ><p>Last.</p></article></body>").split("\n\n") == ["Before.", "After.", "Last."]
    assert html_text.main_text(f"<article><p>One.</p><style>a<b</style><p>Two.</p><script>'</scripts>' i<n</article>{'x' * 300}") == "One.\n\nTwo."


def test_main_text_in_elements_of_doubtful_names():
    long = "This is one of the long paragraphs that the page has for the reader, and it is about the history of the town by the river, " * 2
    for tag in ('article class="post has-sidebar"', 'div class="content with-comments"', 'div id="search-result-article"', 'form id="search"', 'div class="social widget"', 'div itemprop="articleBody" class="share"'):
        name = tag.split()[0]
        page = f"<body><nav>{long}</nav><{tag}><p>{long}</p><div class=cookie-notice>{long}</div><div class='site-footer'>{long}</div><p>{long}</p><p>{long}</p></{name}><div class=related-posts>{long}</div></body>"
        assert html_text.main_text(page).split("\n\n") == [long.strip()] * 3, tag
    comments = f"<article><p>{long}</p><div class=comments>{'<p>' + long + '</p>' * 9}</div></article>"
    assert html_text.main_text(comments) == long.strip()


def test_main_text_about_copyright_and_in_other_languages():
    law = "The copyright of the letters that he wrote in the last years of his life is with the heirs of the house, as it was in the will. " * 2
    assert html_text.main_text(f"<body><p>{law}</p><p>Copyright by me</p></body>") == law.strip()
    polish = "Miasto nad rzeką powstało przed wieloma wiekami, kiedy kupcy szukali drogi przez lasy oraz miejsca na targ. " * 2
    page = f"<body><div><a href=x>{polish}</a></div><p>{polish}</p><p>{polish[:90]}</p></body>"
    assert html_text.main_text(page).split("\n\n") == [polish.strip(), polish[:90].strip()]


def test_main_text_after_a_long_attribute():
    assert html_text.main_text(f"<article><p data-x='{'a>b ' * 3000}'>Text</p></article>") == "Text"


def test_main_text_keeps_captions_and_passes_over_unclosed_elements():
    assert html_text.main_text("<article><p>One.</p><figure><img src=x><figcaption>The caption.</figcaption></figure><noscript><p>Two.</p><svg><p>Three.</p></article>").split("\n\n") == ["One.", "The caption.", "Two.", "Three."]
    assert html_text.main_text("<article><p>One.</p><script>var x = 1;</article>") == "One."


def test_main_text_of_generated_pages():
    """Pages put together from an article and all kinds of other parts give the article back, with and without marks."""
    rng = np.random.default_rng(4)
    frequent = "the of and to in a is that it for was on are as with be at by this from".split()
    rare = ["".join(rng.choice(list("abdefghiklmnoprstu"), rng.integers(4, 9))) for _ in range(300)]

    def sentence(n):
        return " ".join(str(rng.choice(frequent if rng.random() < 0.45 else rare)) for _ in range(n)).capitalize() + "."

    def other(kind):
        if kind == "menu":
            return "<nav><ul>" + "".join(f"<li><a href='/{i}'>{sentence(2)}</a></li>" for i in range(6)) + "</ul></nav>"
        if kind == "links":
            return "<div>" + "".join(f"<p><a href=/{i}>{sentence(12)}</a></p>" for i in range(4)) + "</div>"
        if kind == "script":
            return f"<script>if (a<b) {{ x('</p>{sentence(30)}') }}</script><style>p > a {{}}</style><!-- <p>{sentence(30)}</p> -->"
        if kind == "comments":
            return "<section id='comments'>" + "".join(f"<p>{sentence(40)}</p>" for _ in range(rng.integers(1, 12))) + "</section>"
        return {"header": "<header><h1>Site</h1></header>", "footer": f"<footer><p>&copy; {sentence(40)}</p></footer>", "cookies": f"<div class='cookie-banner'><p>{sentence(40)}</p></div>", "aside": f"<aside><p>{sentence(40)}</p></aside>", "form": f"<form><label>{sentence(8)}</label><input></form>"}[kind]

    for turn in range(60):
        want = [sentence(6), *(sentence(int(rng.integers(40, 90))) for _ in range(rng.integers(2, 7)))]
        body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{x.replace(' ', rng.choice([' ', chr(10), '&#32;', ' <b></b>']), 1)}</p>" for x in want[1:])
        open_, close = ("<article>", "</article>") if turn % 2 else ("<div class='content'>", "</div>")
        kinds = ["menu", "links", "script", "comments", "header", "footer", "cookies", "aside", "form"]
        before = "".join(other(k) for k in rng.permutation(kinds)[: rng.integers(0, 6)])
        after = "".join(other(k) for k in rng.permutation(kinds)[: rng.integers(0, 6)])
        page = f"<!doctype html><html><head><title>{sentence(9)}</title></head><body>{before}{open_}{body}{close}{after}</body></html>"
        assert html_text.main_text(page) == "\n\n".join(want), page
