import base64
import quopri
import random

import numpy as np
import pytest

from weftgraph.llm import leaks as L
from weftgraph.llm.mail import html_text, plain_body, text_parts
from weftgraph.llm.packing import Packing, crossover, evolve, mutated, pack_documents, seeded
from weftgraph.llm.sentences import blocks_of, dictionary_of, lattice_words, sentences, sentences_of

D = dictionary_of([])


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Quist met Prof. Dravost vs. the referee.", "It took 3 hrs. and 20 min. because of a typo.", "pH 7.60 was too low."],
        ["We need beads, ions, etc. in the shell.", "The folder (approx. 10.3 nm wide) looked stable.", "See Fig. 17 and Eq. 42."],
        ['"Is the backup fine?" asked Quist in both boxes.', "(By the way, it blew up.)", "Is it 7.0 or 17.07... or neither?", "Seriously?!", "Please call before 5 p.m. because of that."],
        ['He wrote: "The queue is ready. Nothing else is missing."', "The U.S. node gave two warnings.", "Mr. J. R. Wexlin agrees."],
        ["1. The first point.", "2. The second one took hours.", "3. The last"],
        ["Am 46. Mai passt es nicht.", "Wir haben z. B. 11,6 nm gemessen, d. h. nichts.", "„Stimmt der Wert?“, fragte sie.", "Siehe Abb. 31, Nr. 3: die Kopplung."],
        ["Pourquoi le pas de temps a été déplacé ?", "« Est-ce normal ? » demanda Roe selon le manuel.", "C'est parfait !", "Voir la fig. 39 : fin."],
        ["¡Ya funciona!", "«¿Está listo?», preguntó la Sra. Varnel.", "Nuestro servidor aún corre, p. ej. con 3,2 kJ."],
        ["В 19 г. наш сервер не сходится и т. д. на узле.", "«Всё готово?» — спросил Ossery.", "См. рис. 3, стр. 1."],
        ["«هل انتهى؟» سأل Varnel منذ أمس.", "قال د. Quist إن الغشاء مستقر الآن.", "هل الصندوق كبير؟"],
        ['"सब ठीक है?" Ossery ने बैठक से पहले पूछा।', "डॉ. Melbane ने कहा कि डिब्बा जाँचना होगा।", "झिल्ली स्थिर है!"],
    ],
)
def test_spaced_scripts(want):
    assert sentences_of(" ".join(want), D) == want


def test_long_spans_are_weighed_whole():
    long = "The list (" + " ".join(f"e.g. part {k}" for k in range(40)) + ") is whole."
    assert sentences_of(f"{long} Next one.", D) == [long, "Next one."]
    many = [f'He wrote "part {k} by A. B. Roe" to (us).' for k in range(3000)]
    assert sentences_of(" ".join(many), D) == many


@pytest.mark.parametrize(
    "want",
    [
        ["同事问：“膜体系好了吗？还要多久？”", "见图22（日志和旧图一致。）", "版本24.5里盒子是空的……然后日志没有收敛。", "为什么？", "没有句号"],
        ["「箱は大丈夫ですか。」と同僚が尋ねました。", "第25.2版では記録が変わりました！", "なぜですか?", "よろしく"],
    ],
)
def test_spaceless_scripts(want):
    assert sentences_of("".join(want), D) == want


def test_thai_and_blocks():
    assert sentences_of("ทำไมกล่องว่าง? กล่องใช้ที่มากไป ค่าที่วัดได้คือ16.1", D) == ["ทำไมกล่องว่าง?", "กล่องใช้ที่มากไป", "ค่าที่วัดได้คือ16.1"]
    assert blocks_of("Hi,\n\n> quoted\none  two\nthree\n \n\nend\n-- \nname") == ["Hi,", "one two three", "end"]
    assert blocks_of("a\n-----Original\nb") == ["a"] and blocks_of("") == []


@pytest.mark.parametrize(
    "want",
    [
        ["She moved to 東京 in May.", "Then she left.", "Nobody knew why."],
        ["The word ไทย is short, and so is ภาษา ไทย here.", "Is it?", "Yes."],
        ['He wrote: "One is here. Two is here. Three is here." and then left.', "Next."],
        ["It (see a. One b. Two c. Three d. Four e. Five.) was long.", "So what?"],
        ["Er sagte: „Eins ist da. Zwei ist da. Drei ist da.“ und ging.", "Gut."],
        ["He read 東京です。", "Then he left the room.", "It was late."],
    ],
)
def test_runs_of_scripts_and_long_quotations(want):
    assert sentences_of(" ".join(want), D) == want


def test_runs_inside_spaceless_and_thai_blocks():
    assert sentences_of("我们昨天完成了全部计算。The run was quite long. Then it was over at last. 现在开始新的计算工作。", D) == ["我们昨天完成了全部计算。", "The run was quite long.", "Then it was over at last.", "现在开始新的计算工作。"]
    assert sentences_of("ทำไมกล่องว่าง? See Fig. 3 of it. Then go on. กล่องใช้ที่มากไป", D) == ["ทำไมกล่องว่าง?", "See Fig. 3 of it.", "Then go on.", "กล่องใช้ที่มากไป"]


def test_dictionary_goes_by_shares(spark):
    from weftgraph.llm.sentences import LEAST_SHARE, WORD_LENGTH, dictionary_rows

    few = [("今", 50, 0), ("今日", 50, 0), ("今日は", 4, 0), ("然", 9, 8), ("次", 2, 2)]
    for k in (1, 40_000):
        rows = {r.word: r for r in dictionary_rows(spark.createDataFrame([(w, n * k, d * k) for w, n, d in few], "word string, n long, n_doubtful long")).collect()}
        assert {"今日", "然"} <= set(rows) and rows["今日"].weight < 0 and rows["然"].doubtful and not rows["今日"].doubtful
    assert WORD_LENGTH / LEAST_SHARE == 120_000


def test_word_lattice():
    words = dictionary_of([("今日", -2.1, False), ("今日は", -4.2, False), ("日本", -2.6, False)])
    assert lattice_words("今日日本と", words) == ["今日", "日本", "と"]
    assert lattice_words("", words) == []


def mail(body, kind="text/plain", encoding=None, charset="utf-8", attach=False):
    head = f"Content-Type: {kind}; charset={charset}\n"
    if attach:
        head += 'Content-Disposition: attachment; filename="x"\n'
    if encoding == "base64":
        return head + "Content-Transfer-Encoding: BASE64\n\n" + base64.encodebytes(body.encode(charset)).decode()
    if encoding == "qp":
        return head + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(body.encode(charset)).decode()
    return head + "\n" + body


def multi(parts, boundary="=_b", kind="mixed", closed=True):
    return f'Subject: s\nContent-Type: multipart/{kind};\n boundary="{boundary}"\n\npreamble\n' + "".join(f"--{boundary}\n{p}\n" for p in parts) + (f"--{boundary}--\n" if closed else "")


def test_mail_parts():
    inner = multi([mail("plain é", encoding="qp", charset="iso-8859-1"), mail("<p>html</p>", "text/html")], "=_b.in", "alternative", closed=False)
    m = multi([inner, mail("a;b", "text/csv", "base64", attach=True)])
    for text in (m, m.replace("\n", "\r\n")):
        assert [(p.kind, p.attached, p.text.strip()) for p in text_parts(text)] == [("text/plain", False, "plain é"), ("text/html", False, "<p>html</p>"), ("text/csv", True, "a;b")]
    assert plain_body(None) is None and plain_body("") is None and plain_body(mail("<p>x</p>", "text/html")) is None
    assert plain_body("From: a\n\nbody") == "body" and plain_body(multi([mail("note", attach=True)])) is None
    cut = mail("x" * 300, encoding="base64")[:-100]
    assert plain_body(cut).startswith("x" * 100)
    assert plain_body(mail("hi", encoding="base64").replace("utf-8", "no-such-charset")) == "hi"
    assert html_text("<style>p {}</style><p>a <i>b</i>&nbsp;&amp; c</p>").split() == ["a", "b", "&", "c"]


def test_deep_multiparts_and_attached_messages():
    inner = mail("deep")
    for k in range(1500):
        inner = multi([inner], f"=_{k}_")
    assert [p.text.strip() for p in text_parts(inner)] == ["deep"]
    forwarded = multi(["Content-Type: message/rfc822\n\nSubject: old\n" + mail("old text"), mail("new text")])
    assert [(p.attached, p.text.strip()) for p in text_parts(forwarded)] == [(True, "old text"), (False, "new text")] and plain_body(forwarded).strip() == "new text"


def test_sentences_of_a_table(spark):
    rows = [(1, mail("One two. Three."), "en"), (2, None, "en"), (3, "", None), (4, mail("<p>x</p>", "text/html"), "en"), (5, mail("One two. Three."), "x"), (5, mail("One two. Three."), "x"), (6, mail("word " * 50_000), "en")]
    got = {(r.doc_id, r.sentence) for r in sentences(spark.createDataFrame(rows, "doc_id long, text string, sentence string")).collect()}
    assert got == {(1, "One two."), (1, "Three."), (5, "One two."), (5, "Three."), (6, " ".join(["word"] * 50_000))}
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


VOCABULARY = [f"w{i}{'abcdefg'[i % 7]}" for i in range(900)]


def test_the_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400, np.uint64)
    index = L.ItemIndex.build(6, [(0, h)])
    q = index.prints.copy()
    for k in range(len(q)):
        for b in rng.choice(64, rng.integers(0, L.RADIUS + 1), replace=False):
            q[k] ^= np.uint64(1) << np.uint64(b)
    q = np.concatenate([q, rng.integers(0, 2**63, 2000, np.uint64)])
    got = set(zip(*(a.tolist() for a in index.near(q)), strict=True))
    want = {(i, j) for i in range(len(q)) for j in range(len(index.prints)) if int(q[i] ^ index.prints[j]).bit_count() <= L.RADIUS}
    assert got == want


def test_window_size_leaves_an_unaltered_window():
    rnd = random.Random(3)
    for n in (30, 58, 74, 130, 224, 400):
        w = L.window_size(n)
        for _ in range(300):
            size = rnd.randrange(-(-n // 3), n + 1)
            altered = set(rnd.sample(range(size), size // 8))
            clean = max(len(r) for r in "".join(" " if i in altered else "x" for i in range(size)).split())
            assert clean >= w


def test_leaks_planted_and_not(spark):
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choices(VOCABULARY, k=rnd.randrange(60, 140))), 1) for i in range(25)] + [(90, None, 1), (91, "", 1), (92, "too short", 1)]
    docs, want = [], set()
    for d in range(160):
        filler = lambda: " ".join(rnd.choices(VOCABULARY, k=rnd.randrange(20, 200)))
        text = filler()
        if d % 2:
            i, passage, _ = rnd.choice(items[:25])
            words = passage.split()
            share = rnd.choice([0.2, 0.45, 0.7, 1.0])
            size = int(len(words) * share)
            at = rnd.randrange(len(words) - size + 1)
            part = words[at : at + size]
            for k in rnd.sample(range(1, size - 1), max(0, size // 8 - 1)):
                part[k] = "Altered"
            piece = " ".join(w.upper() if rnd.random() < 0.1 else w.replace("a", "а") for w in part)
            if share > 0.4:
                want.add((d, i))
            text = f"{text}\n> {piece[:200]}\n> {piece[200:]}\n{filler()}" if "\n" not in piece[195:205] and piece[199:201].strip() != piece[199:201] else f"{text} {piece}, {filler()}"
        form = rnd.randrange(4)
        docs.append((d, mail(text, encoding=[None, "base64", "qp", None][form], attach=form == 1) if form < 3 else mail(f"<p>{text.replace('> ', '')}</p>", "text/html"), 0))
    docs += [(500, None, 0), (501, "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    ev = spark.createDataFrame(items, "item_id int, passage string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(df, ev).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(df, ev, max_held_words=500).collect()} == want
    assert L.leaked_items(df.limit(0), ev).count() == 0 and L.leaked_items(df, ev.limit(0)).count() == 0


def test_genetic_operators_keep_every_item():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 4000, 300)
    a, b = seeded(sizes, 8192, rng, 0.3), seeded(sizes, 8192, rng, 0.3)
    for p in (a, crossover(a, b, sizes, 8192, rng), mutated(a, sizes, 8192, rng)):
        assert isinstance(p, Packing) and (p.bin_of >= 0).all()
        fill = np.bincount(p.bin_of, sizes, len(p.fill))
        assert fill.tolist() == p.fill and fill.max() <= 8192
    best = evolve(sizes, [], 8192, rng, 5, 6)
    assert best[0].fitness(8192) >= max(seeded(sizes, 8192, rng, 0.0).fitness(8192), best[-1].fitness(8192))
    one = evolve(np.array([5]), [], 10, rng, 2, 4)
    assert one[0].bin_of.tolist() == [0]


def test_evolution_saves_containers_over_best_fit():
    for seed in range(3):
        sizes = np.random.default_rng(seed).integers(1500, 4000, 600)
        best = evolve(sizes, [], 8192, np.random.default_rng([seed, 1]), 6, 8)[0]
        assert np.bincount(best.bin_of, sizes).max() <= 8192 and (best.bin_of >= 0).all()
        assert len(best.fill) <= len(seeded(sizes, 8192, np.random.default_rng(0), 0.0).fill) - 3


def test_packing_of_a_table(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randrange(1, 5000), i) for i in range(1500)] + [(2000, "é" * 9000, 0), (2001, "y" * 8192, 0), (2002, None, 0), (2003, "", 0)] + [(7, "same", 0)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = pack_documents(df, shard_items=300).collect()
    fill, bytes_of = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
        bytes_of.setdefault(r.doc_id, []).append((r.piece, r.offset, r.size))
    assert max(fill.values()) <= 8192 and len(got) == len(rows) + 2
    assert sorted(bytes_of[2000]) == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 1616)]
    assert bytes_of[2001] == [(0, 0, 8192)] and bytes_of[2002] == [(0, 0, 0)]
    assert sum(fill.values()) == sum(len((t or "").encode()) for _, t, _ in rows)
    assert sum(fill.values()) / (8192 * len(fill)) > 0.97
    assert pack_documents(df.limit(0)).count() == 0


def test_leaks_with_words_left_out_and_put_in(spark):
    item = [f"w{i}x" for i in range(90)]
    part = item[20:50]
    left_out = [w for i, w in enumerate(part) if i not in (10, 14)]
    put_in = [*part[:10], "new", *part[10:14], "new", *part[14:]]
    scrap = [w for i, w in enumerate(part) if i not in (4, 8, 12, 16, 20, 24)]
    around = [f"v{i}" for i in range(40)]
    docs = [(k, mail(" ".join([*around, *p, *around]))) for k, p in enumerate((left_out, put_in, scrap))]
    found = L.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, passage string"))
    assert {(r.doc_id, r.share) for r in found.collect()} == {(0, 30 / 90), (1, 30 / 90)}


def _leak_tables(spark, docs, items):
    return spark.createDataFrame([(k, mail(" ".join(w))) for k, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, passage string")


def test_windows_joined_by_block_find_the_same(spark):
    rnd = random.Random(11)
    items = [rnd.choices(VOCABULARY, k=rnd.randrange(60, 140)) for _ in range(12)] + [["one", "two", "three"]]
    docs = []
    for d in range(60):
        item = rnd.choice(items)
        part = list(item[: int(len(item) * rnd.choice([0.2, 0.5, 1.0]))])
        if len(part) > 10:
            part[rnd.randrange(1, len(part) - 1)] = "altered"
        docs.append([*rnd.choices(VOCABULARY, k=50), *part, *rnd.choices(VOCABULARY, k=50)])
    tables = _leak_tables(spark, docs, items)
    held = sorted(map(tuple, L.leaked_items(*tables).collect()))
    assert held and sorted(map(tuple, L.leaked_items(*tables, max_held_words=10).collect())) == held


def test_the_radius_finds_what_equal_fingerprints_miss(spark):
    """Windows of item size: each holds an altered word, so none is equal, but some fingerprints lie within the radius."""
    rnd = random.Random(5)
    items = [rnd.sample(VOCABULARY, 80) for _ in range(30)]
    docs = []
    for item in items:
        part = list(item)
        part[26] = part[53] = "altered"
        docs.append(part)
    tables = _leak_tables(spark, docs, items)
    at = {r: {x.item_id for x in L.leaked_items(*tables, radius=r, window=60).collect()} for r in (0, 3)}
    assert not at[0] and len(at[3]) > 5
    assert {x.item_id for x in L.leaked_items(*tables).collect()} == set(range(30))


def test_stock_lines_and_short_items(spark):
    rnd = random.Random(3)
    stock = [f"s{k}" for k in range(20)]
    items = [[*stock, *rnd.sample(VOCABULARY, 25)] for _ in range(20)] + [["tiny", "item"], ["four", "words", "in", "all"]]
    docs = [["x", *stock, "y"], [*stock, *items[3][20:]], ["a", "tiny", "item", "b"], ["four", "words", "in"], ["four", "words", "in", "all"], ["tiny", "x", "item"]]
    found = {(r.doc_id, r.item_id): r for r in L.leaked_items(*_leak_tables(spark, docs, items)).collect()}
    assert set(found) == {(1, 3), (2, 20), (4, 21)}
    assert found[1, 3].share == 1 and found[1, 3].weight == pytest.approx(1)


def test_alignment_of_long_items_in_blocks():
    rnd = np.random.default_rng(4)
    item = rnd.integers(1, 1 << 60, 1500, np.uint64)
    doc = np.concatenate([item[:400], item[405:900], rnd.integers(1, 1 << 60, 3, np.uint64), item[900:]])
    rows, L.BLOCK_ROWS = L.BLOCK_ROWS, 100
    try:
        a = L.aligned([(doc, item, -20, 20), (doc, item[:30], -5, 5)])
    finally:
        L.BLOCK_ROWS = rows
    b = L.aligned([(doc, item, -20, 20)])
    assert all((x == y).all() for x, y in zip(a[0], b[0], strict=True))
    equal, of_item = a[0]
    assert of_item.sum() == 1500 and (~equal).sum() == 8 and a[1][0].all() and len(a[1][0]) == 30
