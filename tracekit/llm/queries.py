"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tracekit.llm import bpe, editprint, forest, langid, mixing, neardup, packing, pagetext, periodic, repeats, restaurants, variants, zipwarc
from tracekit.llm.common import plain, whole_text
from tracekit.plans.registry import query, table
from tracekit.session import cut, scratch_path, tidy


def token_digests(df):
    """Digest columns of a table with ids and decoded text."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_bpe")
def op10(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text").withColumn("text", whole_text())
    coded = bpe.encode(docs).drop("text")
    return token_digests(bpe.decode(coded))


@query("op7_zipwarc", """
    with p as (
      select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
    f as (select payload_digest, min(page_id) as first_id, count(*) as n from p where payload_bytes >= 100 group by 1),
    r as (select p.*, case when payload_bytes >= 100 and n > 1 and first_id is not null and page_id is distinct from first_id then first_id end as refers_to
      from p left join f using (payload_digest))
    select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from r
    """)
def op7(spark, sf):
    records = zipwarc.plan_records(plain(table(spark, sf, "pages"), "page_id", "url", "html"))
    manifest = cut(zipwarc.write_archives(records, scratch_path(spark, "archives")), "manifest")
    found = zipwarc.read_records(zipwarc.locate_records(manifest))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_langid")
def op9(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query("op6_pagetext")
def op6(spark, sf):
    pages = plain(table(spark, sf, "pages"), "page_id", "url", "html")
    return pagetext.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op2_editprint")
def op2(spark, sf):
    return editprint.with_classes(plain(table(spark, sf, "documents"), "doc_id", "text"), editprint.LEAST)


@query("op5_repeats", r"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    m as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(\n)(\S)', '\1' || chr(1) || '\2', 'g'), '([.!?]\s)(\S)', '\1' || chr(1) || '\2', 'g'), '([.!?]\s)(\S)', '\1' || chr(1) || '\2', 'g'),
        '(\s)(\p{Lu})', '\1' || chr(1) || '\2', 'g') as marked from t),
    p as (select doc_id, list_filter(string_split(marked, chr(1)), lambda x: x <> '') as s from m),
    e as (select doc_id, unnest(s) as piece, generate_subscripts(s, 1) - 1 as i from p),
    n as (select doc_id, i, piece, lower(trim(regexp_replace(piece, '\s+', ' ', 'g'))) as s from e),
    c as (select doc_id, i, piece, s, case when s = '' then 0 else length(s) - length(replace(s, ' ', '')) + 1 end as w from n),
    r as (
      select doc_id, i, s || chr(1) || lead(s) over (partition by doc_id order by i) as h, 2 as width from c
      union all select doc_id, i, s as h, 1 as width from c where w >= 20),
    o as (select doc_id, i, width, row_number() over (partition by width, h order by doc_id, i) as place from r where h is not null),
    f as (select distinct doc_id, i + unnest(range(width)) as i from o where place > 1),
    g as (select f.doc_id, f.i, c.w, f.i - row_number() over (partition by f.doc_id order by f.i) as island from f join c using (doc_id, i)),
    k as (select doc_id, i, sum(w) over (partition by doc_id, island) as total from g),
    x as (select doc_id, i from k where total >= 20),
    d as (select c.doc_id, string_agg(c.piece, '' order by c.i) filter (where x.i is null) as kept, count(x.i) as sentences_removed
      from c left join x using (doc_id, i) group by 1)
    select t.doc_id, coalesce(d.kept, '') as text, length(coalesce(d.kept, '')) as n_chars, coalesce(sentences_removed, 0) as sentences_removed
    from t left join d using (doc_id)
    """)
def op5(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text").withColumn("text", whole_text())
    return repeats.remove_repeats(docs).select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "sentences_removed")


def _mix_sql(rounds: int) -> str:
    """The rounds of ``mixing.rake`` spelled out, one common table per half step."""
    parts = ["""
    t as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, coalesce(text, '') as text from documents),
    d as (select doc_id, source, lang, len(regexp_extract_all(text, '\\S+')) as n_tokens,
      case when length(text) = 0 then 'empty' when contains(text, ' | ') then 'table'
        when len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s.,]')) * 20 > length(text) then 'marked'
        when length(text) < 600 then 'short' when length(text) >= 4000 then 'long' else 'prose' end as topic from t),
    c as (select source, lang, topic, sum(n_tokens)::double as n from d group by all having sum(n_tokens) > 0),
    w0 as (select *, n / sum(n) over () as present, n / sum(n) over () as w from c)"""]
    for dim in ("source", "lang", "topic"):
        parts.append(f"g_{dim} as (select {dim}, pow(sum(n), 0.8) as part from c group by 1), "
                     f"s_{dim} as (select {dim}, part / sum(part) over () as share from g_{dim})")
    k = 0
    for _ in range(rounds):
        for dim in ("source", "lang", "topic"):
            parts.append(f"w{k + 1} as (select * exclude (w, share), w * share / sum(w) over (partition by {dim}) as w from w{k} join s_{dim} using ({dim}))")
            k += 1
    return "with " + ",".join(parts) + f""",
    r as (select source, lang, topic, (w / present) / max(w / present) over () as p from w{k}),
    f as (select d.*, case when n_tokens > 0 then coalesce(p, 0) else 1.0 end as p from d left join r using (source, lang, topic))
    select doc_id, source, lang, topic, n_tokens, round(p, 6) as probability,
      ('0x' || substr(md5('mix|' || doc_id), 1, 8))::bigint / 4294967296 < p as kept from f"""


@query("op3_mixing", _mix_sql(mixing.ROUNDS))
def op3(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text", "lang", "source")
    text = whole_text()
    docs = docs.select("doc_id", "source", "lang", mixing.topic(text).alias("topic"), mixing.n_tokens(text).alias("n_tokens"))
    mixed = mixing.sample_mix(docs, ["source", "lang", "topic"], "n_tokens", "doc_id")
    named = [F.coalesce(F.col(c), F.lit(mixing.NONE)).alias(c) for c in ("source", "lang")]
    return mixed.select("doc_id", *named, "topic", "n_tokens", tidy("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


@query("op4_neardup")
def op4(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text")
    return neardup.near_classes(docs).select("doc_id", "class_id", "kept")


@query("op1_forest")
def op1(spark, sf):
    rows = plain(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return forest.neighbours(rows, rows.where("vec_id % 20 = 0"), 20)


@query("op8_restaurants")
def op8(spark, sf):
    return restaurants.score_corpus(plain(table(spark, sf, "documents"), "doc_id", "text"))


@query("op11_packing")
def op11(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text")
    return packing.pack(packing.pieces(docs).drop("ids"))


def _periodic_tail():
    """The text, in a tenth of the documents (by checksum of doc_id) with a tail of words that repeats itself."""
    return F.expr(r"""
        case when text <> '' and crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 then
          array_join(transform(
            array(named_struct('w', regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), 'g', crc32(cast(cast(doc_id as string) as binary)) div 10)),
            x -> if(size(x.w) = 0, '', array_join(transform(x.w, (word, i) -> if(i < x.g % size(x.w), word,
              element_at(x.w, cast(x.g % size(x.w) + (i - x.g % size(x.w)) % (1 + (size(x.w) - x.g % size(x.w)) div (3 + x.g % 8)) as int) + 1))), ' '))), '')
        else text end""")


@query("op12_periodic")
def op12(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text").withColumn("text", whole_text())
    found = periodic.find_runs(docs.select("doc_id", _periodic_tail().alias("text"))).drop("text")
    # the longest run; of equal ones the first, then that of the smallest period, which is the order of the list
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    found = found.withColumn("best", longest)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.expr("best.length * 1000 div -best.less").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def lost_letter(key: bytes, words: list[bytes]) -> list[bytes]:
    """One in 31 of a document's words, by checksum, without one of its letters."""
    head, out = zlib.crc32(key + b":"), []
    for word in words:
        h = zlib.crc32(word, head)
        if h % 31 == 0:
            letters = word.decode("utf-8")
            at = h % len(letters)
            word = (letters[:at] + letters[at + 1 :]).encode("utf-8")
        out.append(word)
    return out


@query("op13_variants")
def op13(spark, sf):
    docs = plain(table(spark, sf, "documents"), "doc_id", "text")
    return variants.group_variants(variants.count_words(docs, change=lost_letter).where("n >= 2"))
