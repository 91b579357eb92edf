"""Merkle manifest and tokenizer alignment against plain Python; extraction of planted articles."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earshot.llm import html_extraction, merkle, token_alignment
from tests.llm.test_text_operators import SCHEMA, cases, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, place):
    for level in levels[:-1]:
        first = place // 8 * 8
        yield level[first:place], level[place + 1:first + 8]
        place //= 8


def manifest_plain(rows):
    """Rows (doc_id, text, lang, source, n_chars): what the whole trees give."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), i, text, source, n))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([r[2] for r in sorted(groups[lang], key=lambda r: r[:3])]) for lang in order}
    top = levels_of([trees[lang][-1][0] for lang in order])
    for k, lang in enumerate(order):
        for place, (_, _, own, i, text, source, n) in enumerate(sorted(groups[lang], key=lambda r: r[:3])):
            path = [*siblings(trees[lang], place), *siblings(top, k)]
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(i, source, lang, n, text)
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            yield (i, own, trees[lang][-1][0], top[-1][0], sha("".join(d for step in path for part in step for d in part)),
                   folded, folded == top[-1][0])


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_whole_trees(spark, levels):
    rows = [r[:5] for r in cases()] + [(1000 + i, f"Text {i}", ("de", None, "é", "")[i % 7 % 4], "s", i) for i in range(130)]
    rows += [(2000, "The only one", "xx", "s", 1)]
    docs = spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:5])).withColumn("row", F.lit("other")).repartition(3)
    got = merkle.manifest(docs, altered={"text": merkle.lowered_thirds()}, levels=levels)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, manifest_plain(rows)))
    assert any(r["verified"] for r in got.collect()) and not all(r["verified"] for r in got.collect())


def test_manifest_of_few_rows_and_witnesses(spark):
    schema = ", ".join(SCHEMA.split(", ")[:5])
    for rows in ([], [(1, "A", "en", "s", 1)], [(1, "A", "en", "s", 1)] * 2, [(i, None, None, None, None) for i in range(9)]):
        got = merkle.manifest(spark.createDataFrame(rows, schema), witness=True).collect()
        assert sorted(tuple(r)[:5] for r in got) == sorted(r[:5] for r in manifest_plain(rows))
        assert all(merkle.fold(r["leaf"], r["witness"]) == r["root"] and r["verified"] for r in got)
        assert not any(merkle.fold(sha("other"), r["witness"]) == r["root"] for r in got)


def test_open_subtrees_extend_partial_witnesses():
    tree = merkle.OpenSubtrees(fan=2)
    for d in "abc":
        tree.append(d)
    assert tree.partial == [",b;", "a,;", ""]  # c waits for its sibling
    tree.append("d")
    assert tree.partial[0] == f",b;,{sha('cd')};" and tree.partial[3] == f"c,;{sha('ab')},;"


def alignment_plain(rows):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letters, docs = token_alignment.byte_alphabet(), []
    for i, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            a = a_side.encode(" " + text, add_special_tokens=False)
            tokens = [[(k, bytes(letters[c] for c in t)) for k, t in zip(a.ids, a.tokens)],
                      [(k, bytes([int(p[3:5], 16)]) if b_side.is_byte(k) else p.replace("▁", " ").encode())
                       for k, p in zip(b_side.encode(text), b_side.encode(text, out_type=str))]]
            if all(b"".join(t for _, t in side) == (" " + text).encode() for side in tokens):
                ends = [{}, {}]
                for side, at in zip(tokens, ends):
                    place = 0
                    for k, t in side:
                        place += len(t)
                        at[place] = k
                links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
                low = 0
                for e in sorted(ends[0].keys() & ends[1].keys()):
                    groups.append("|".join(",".join(str(at[x]) for x in sorted(at) if low < x <= e) for at in ends))
                    low = e
                n = len(tokens[0]), len(tokens[1])
        docs.append((i, n, groups, links))
    counts = Counter(link for *_, links in docs for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, *n, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             sha(";".join(groups)) if groups else "") for i, n, groups, links in docs]


def test_alignment_equals_plain_python(spark, monkeypatch):
    odd = ["<|endoftext|> a <s> </s> <unk>", "▁x", "é́ ½ 日本 \x00 \U0001f600 <0x41>", "  two  spaces \n\n\ttab", " ",
           " lead", "trail ", "\r\n", "a b"]
    rows = [(i, t[:4000] if t else t) for i, t, *_ in cases()] + [(500 + i, t) for i, t in enumerate(odd)]
    rows += [(600 + i, prose(i, 60, "fr")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).repartition(4)
    got = token_alignment.consistency(docs, A, B)
    want = sorted(map(repr, alignment_plain(rows)))
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 10)  # the join that shuffles
    assert sorted(map(repr, map(tuple, token_alignment.consistency(docs, A, B, salts=3).collect()))) == want
    assert token_alignment.consistency(docs.limit(0), A, B).collect() == []


def page(rng, host, title, paragraphs, extra=""):
    """A page in the manner of one of five sites; all but the article is boilerplate."""
    links = "".join(f"<li><a href='/{rng.random()}'>menu {rng.choice('abcdef')} {rng.randint(1, 99)}</a></li>" for _ in range(6))
    noise = f"buy now {rng.randint(1, 999)}"
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if host == 0:
        main = f"<header><h2>Site</h2></header><nav><ul>{links}</ul></nav><main><article><h1>{title}</h1>{body}<p>Share this story</p>" \
               f"<div class='ad-slot'>{noise}</div></article></main><aside>{noise}</aside><footer>&copy; {noise}"
    elif host == 1:  # no article element
        main = f"<div id=menu><ul>{links}</ul></div><div class='cookie-notice'>{noise}</div><div id='content'><h1>{title}</h1>{body}" \
               f"<form action=x><label>mail</label><input>{noise}</form></div><div class=sidebar><p>{noise}</p></div>"
    elif host == 2:  # nothing is named
        main = f"<div><ul>{links}</ul></div><div><h1>{title}</h1>{body}</div><div>Imprint and terms of use</div>"
    elif host == 3:  # comments are articles, too, and lists don't close
        main = f"<nav><ul>{links.replace('</li>', '')}</ul></nav><article class='post tag-cookies'><h1>{title}</h1>{body}</article>" \
               f"<section id=comments><article class=comment><p>{noise}</p></article></section><script>var x = '<p>{noise}</p>';</script>"
    else:
        main = f"<div class='has-sidebar'><div role=navigation>{links}</div><div class='story'><h1>{title}</h1>{body}</div>" \
               f"<div class='Newsletter-Signup'>{noise}</div><!-- <p>{noise}</p> --></div>"
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{main}{extra}"


def test_planted_articles_come_back_whole(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(150):
        host = i % 5
        texts = [prose(1000 + 20 * i + k, rng.randint(5, 60)) for k in range(rng.randint(1, 8))]
        title = prose(7000 + i, 5)
        rows.append((i, f"https://User@Host{host}.example.org:80/a/{i}?q=//x", page(rng, host, title, [
            t.replace("the", "<b>the</b>").replace("ing", "&#105;ng") + " &amp; <br>more" for t in texts])))
        want[i] = "\n\n".join([" ".join(title.split())] + [" ".join((t + " & more").split()) for t in texts])
    copy = page(rng, 0, "One title", ["The same words.", "Again the same."])  # a host of copies keeps its article
    rows += [(200 + i, "http://copies.example.org/", copy) for i in range(20)]
    near = [page(rng, 3, f"Title {i}", [prose(5, 50), prose(6, 50), prose(7, 50)]) for i in range(12)]
    rows += [(300 + i, "http://near.example.org/", p) for i, p in enumerate(near)]
    rows += [(400, None, None), (401, None, ""), (None, "x", "plain &lt; text <p"), (402, "http://a/", "<p>" + "<div>" * 3000 + "deep")]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).repartition(4)
    got = {}
    for r in html_extraction.main_text(pages).collect():
        assert got.setdefault(r["page_id"], r["text"]) == r["text"] and r["n_chars"] == len(r["text"])
    assert {i: got[i] for i in want} == want
    assert all(got[200 + i] == "One title\n\nThe same words.\n\nAgain the same.\n\nShare this story" for i in range(20))
    assert all(got[300 + i].count("\n\n") == 3 for i in range(12))
    assert got[400] == got[401] == "" and got[None] == "plain < text" and got[402] == "deep"
    assert html_extraction.main_text(pages.limit(0)).collect() == []


def test_constant_texts_are_template(spark):
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, "http://h/", page(rng, 0, f"T {i}", [prose(i, 30)])) for i in range(20)],
                                  "page_id long, url string, html string")
    wrapper = html_extraction.induce(pages).first()
    assert len(wrapper["constants"]) == 1 and "div.ad-slot" in wrapper["reference"]
    few = html_extraction.main_text(pages.where("page_id < 3")).collect()  # too few pages to tell
    assert all("Share this story" in r["text"] for r in few)
    assert not any("Share this" in r["text"] for r in html_extraction.main_text(pages).collect())


def test_tree_matching_is_the_largest_in_order():
    a, b = map(html_extraction.read_shape, ("r a x ) ) b ) c ) )", "r c ) a x ) y ) ) b ) )"))
    match = html_extraction.tree_matching(a, b)
    assert match == {0: 0, 1: 2, 2: 3, 3: 5}  # root, a, x and b; c would cross
