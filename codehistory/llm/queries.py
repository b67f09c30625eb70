"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, language, ngrams, periodic, phrases, pieces, quality, quotes, scoring, substrings, tokenfiles, toxicity

WHITE = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(of: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = language.learn(docs.where(_remainder(4) != 2))
    found = language.identify(docs, trees)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.written(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), arrays=())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
with d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select item_id, w, least(13, len(w)) as k, unnest(range(1, cast(len(w) - least(13, len(w)) + 2 as bigint))) as pos_ from i where len(w) > 0),
t as materialized (select distinct item_id, k, array_to_string(w[pos_:pos_ + k - 1], ' ') as win from p),
k as (select distinct k from t),
dp as (select doc_id, k, w, unnest(range(1, cast(greatest(len(w) - k + 2, 1) as bigint))) as pos_ from d, k),
dw as (select doc_id, k, pos_, array_to_string(w[pos_:pos_ + k - 1], ' ') as win from dp),
hit as materialized (select dw.doc_id, dw.k, dw.pos_, t.item_id from dw join t on dw.k = t.k and dw.win = t.win),
hits as (select distinct doc_id, unnest(range(pos_, cast(pos_ + k as bigint))) as pos_ from hit),
n as (select doc_id, count(*) as n_hit from hits group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n on n.doc_id = d.doc_id left join it on it.doc_id = d.doc_id
"""


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(5) == 1, F.lit(False)))
    return scoring.score(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, cast(greatest(len(w) - 11, 1) as bigint))) as pos_ from d),
win as materialized (select doc_id, pos_, array_to_string(w[pos_:pos_ + 12], ' ') as win from p),
f as (select win, min(doc_id) as first from win group by win having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(pos_, cast(pos_ + 13 as bigint))) as pos_ from (select win.doc_id, win.pos_ from win join f on win.win = f.win where win.doc_id > f.first)),
each_word as (select doc_id, unnest(w) as word, unnest(range(1, cast(len(w) + 1 as bigint))) as pos_ from d),
kept as (select e.doc_id, count(*) as n, string_agg(e.word, ' ' order by e.pos_) as t from each_word e anti join gone g on e.doc_id = g.doc_id and e.pos_ = g.pos_ group by e.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""

def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.linked(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, cast(greatest(len(w) - 2, 2) as bigint))) as pos_ from d where len(w) > 0),
g as materialized (select distinct doc_id, array_to_string(w[pos_:pos_ + 3], ' ') as gram from p),
n as materialized (select doc_id, count(*) as n from g group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as common from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
e as materialized (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from d union select e.b, r.root from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n on n.doc_id = d.doc_id
join (select doc_id, min(root) as component_id from r group by doc_id) c on c.doc_id = d.doc_id
"""

def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations"))


def quotations_found_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with each message quoted by the next one but one, so that there are links to find."""
    turns = _table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").dropDuplicates(["conv_id", "turn"])
    again = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("said"))
    quoted = F.concat(F.lit("> "), F.regexp_replace("said", "\n", "\n> "), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    made = turns.join(again, ["conv_id", "turn"], "left").withColumn("text", F.when(F.col("said").isNull(), F.col("text")).otherwise(quoted))
    return quotes.link(made).select("conv_id", "turn", "parent_turn", "n_quotes", "n_linked", F.size("path").cast("long").alias("above"))


QUOTES_SQL = r"""
with recursive t as (select distinct conv_id, turn, text from conversations where conv_id is not null and turn is not null),
n as materialized (select conv_id, turn, trim(coalesce(text, ''), E' \t\n\r\f\x0b') as body, text from t),
p as (select conv_id, turn, unnest(list_concat([body], string_split(body, chr(10)))) as part from n),
q as materialized (select distinct conv_id, turn, regexp_replace(regexp_replace(lower(part), '\s+', ' ', 'g'), '^[\s\pP]+|[\s\pP]+$', '', 'g') as part from p),
asked as (select x.conv_id, x.turn + 2 as turn, x.part from q x join n on n.conv_id = x.conv_id and n.turn = x.turn + 2 where x.part <> ''),
hit as (select a.conv_id, a.turn, length(a.part) as size, max(s.turn) as source from asked a join q s on s.conv_id = a.conv_id and s.part = a.part and s.turn < a.turn group by all),
best as materialized (select conv_id, turn, arg_max(source, size * 1000000000 + source) as parent from hit group by all),
up(conv_id, turn, above) as (select n.conv_id, n.turn, 1 from n left join best b on b.conv_id = n.conv_id and b.turn = n.turn where b.parent is null union all select b.conv_id, b.turn, up.above + 1 from up join best b on b.conv_id = up.conv_id and b.parent = up.turn)
select n.conv_id, n.turn, coalesce(b.parent, lag(n.turn) over (partition by n.conv_id order by n.turn)) as parent_turn,
  cast(exists (select 1 from n m where m.conv_id = n.conv_id and m.turn + 2 = n.turn and m.text is not null) as bigint) as n_quotes, cast(b.parent is not null as bigint) as n_linked, cast(up.above as bigint) as above
from n left join best b on b.conv_id = n.conv_id and b.turn = n.turn join up on up.conv_id = n.conv_id and up.turn = n.turn
"""

def _repeating(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text); one in ten, by the hash of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def again(w: F.Column) -> F.Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        word = lambda i: F.try_element_at(w, (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

    # the words are bound once, not cut out anew for each place
    changed = F.transform(F.array(F.regexp_extract_all("text", F.lit(WHITE), F.lit(0))), lambda w: F.when(F.size(w) > 0, again(w)))[0]
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_repeating(_table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("*", best.alias("b"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div -b.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


OP11_SQL = r"""
with w0 as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as h from documents),
w1 as materialized (select doc_id, w, h, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from w0),
w2 as materialized (select doc_id, w, n, a, 1 + (n - a) // (3 + (h // 10) % 8) as p from w1),
d as materialized (select doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) end as w from w2),
g as materialized (select doc_id, unnest(range(0, n - 5)) as i, unnest(list_transform(range(1, n - 4), lambda i: hash(w[i:i + 5]))) as h from d where n >= 12),
often as materialized (select doc_id, h from g group by all having count(*) > 1),
few as materialized (select g.* from g join often using (doc_id, h)),
same as (select x.doc_id, x.i, y.i - x.i as p from few x join few y on x.doc_id = y.doc_id and x.h = y.h and x.i < y.i),
land as (select doc_id, p, i - row_number() over (partition by doc_id, p order by i) as k, i from same),
cand as (select doc_id, min(i) as start_, p, count(*) + 5 + p as length_ from land group by doc_id, p, k having count(*) + 5 + p >= greatest(12, 2 * p)),
runs as materialized (select doc_id, start_, length_, min(p) as p from cand group by all),
gone as (select distinct doc_id, unnest(range(start_ + p, start_ + length_)) as i from runs),
left_ as (select x.doc_id, string_agg(x.word, ' ' order by x.i) as t from (select doc_id, unnest(w) as word, unnest(range(0, n)) as i from d) x anti join gone on gone.doc_id = x.doc_id and gone.i = x.i group by x.doc_id),
best as (select doc_id, count(*) as n_runs, string_agg(start_ || ',' || length_ || ',' || p || chr(10), '' order by start_, p) as said, first(struct_pack(s := start_, l := length_, p := p) order by length_ desc, start_, p) as b from runs group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.p as period, 1000 * b.l // b.p as exponent_milli, sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from d left join best on best.doc_id = d.doc_id left join left_ on left_.doc_id = d.doc_id
"""
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents),
w as materialized (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from p),
total as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3), (4)) ks(k))),
f as materialized (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 30),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
cut as (select c.*, j, array_to_string(c.w[1:j], ' ') as x, array_to_string(c.w[j + 1:], ' ') as y from c, (values (1), (2), (3)) js(j) where j < k),
s as (select cut.lang, cut.phrase, cut.k, cut.a, j, x.a as l, y.a as r, cast((cast(2000000 as hugeint) * cut.a) // (x.a + y.a) as bigint) as score from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y),
b as materialized (select lang, phrase, k, a, min(struct_pack(score := score, j := j, l := l, r := r)) as c from s group by all),
longer as (select lang, array_to_string(w[1:k - 1], ' ') as phrase, a from c union all select lang, array_to_string(w[2:], ' ') as phrase, a from c),
most as (select lang, phrase, max(a) as more from longer group by all),
stay as (select b.* from b left join most on most.lang = b.lang and most.phrase = b.phrase where more is null or 100 * more < 80 * b.a),
ranked as (select *, row_number() over (partition by lang order by c.score desc, a desc, phrase) as rank from stay)
select ranked.lang, rank, phrase, a, c.l as l, c.r as r, n, c.score as score from ranked join total on total.lang = ranked.lang where rank <= 2000
"""


def _last_third(text: str, following: str) -> str:
    """A text with its last third replaced by as many characters of the next one, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(_table(spark, sf_dir, "documents"), _last_third)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scores": op5_lm_scores,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_quotation_links": op10_quotation_links,
    "quotations_found_again": quotations_found_again,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_document_fingerprints": op13_document_fingerprints,
}

SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op8_ngram_join": OP8_SQL, "quotations_found_again": QUOTES_SQL, "op11_periodic_runs": OP11_SQL, "op12_phrase_mining": OP12_SQL}
