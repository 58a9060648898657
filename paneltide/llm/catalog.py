"""The operators' queries over whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import (
    chat,
    lengths,
    line_chunks,
    outliers,
    page_text,
    periodic_runs,
    pseudonyms,
    simhash,
    substring_repeats,
    suffix_array,
    token_alignment,
    warc,
)
from paneltide.llm.byte_bpe import Vocabulary, round_trip

RANKS = "byte_bpe_50k.tiktoken"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The key of the registered query; a real run passes its own.
DEMO_KEY = b"paneltide-demo-key"
CAPTURED = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary.read(path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"), DEMO_KEY)


def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = suffix_array.match_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_chunks.dedup_chunks(table(spark, sf_dir, "documents"), rule=line_chunks.content_chunks)  # as its SQL states
    return cut.select("doc_id", "text", "n_chunks_removed", "n_lines_removed")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_chunks.dedup_chunks(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "n_chunks_removed", "n_lines_removed")


def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"), ("doc_id",)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages"), CAPTURED), ("page_id",))
    return made.select("page_id", "warc_type", "record_id", "refers_to", F.decode("record", "UTF-8").alias("record"))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    counts = lengths.histogram(lengths.with_lengths(docs, vocabulary()).select("n_tokens"))
    return lengths.length_table(counts)


def op10_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = f"{chat.END}{chat.START}assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.conversation_report(turns.union(added))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period planted in the tail of one text in ten, chosen by its id; none without an id."""
    value = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if value % 10 or not words:
        return words
    g, n = value // 10, len(words)
    start = g % n
    root = words[start : start + 1 + (n - start) // (3 + g % 8)]
    return words[:start] + (root * (n // len(root) + 1))[: n - start]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.with_runs(docs, key="doc_id", rewrite=planted_period).select(
        "doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"), periodic_runs.strongest(F.col("runs")).alias("best")
    )
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = map(public_tokenizers.path, ALIGNED)
    both = token_alignment.RankedBytes(first, public_tokenizers.PATTERN), token_alignment.Pieces(second)
    found = token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *both)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms,
        op2_suffix_array_decontamination,
        op3_line_chunks,
        op3_repeated_passages,
        op4_covering_simhash,
        op5_tree_scored_text,
        op6_byte_bpe,
        op7_robust_outliers,
        op8_warc_derivatives,
        op9_length_histogram,
        op10_budgeted_windows,
        op11_periodic_runs,
        op12_token_alignment,
        op13_seed_extend_dedup,
    )
}

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_suffix_array_decontamination": f"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOW.format('text')}, {_WORDS}), []) as w from documents),
b as (select item_id, regexp_extract_all({_LOW.format('text')}, {_WORDS}) as w from benchmark),
bw as (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as g from bw),
sizes as (select distinct n from win),
dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n),
hits as (select doc_id, item_id, dw.n, p from dw join win on dw.n = win.n and array_to_string(w[p:p + dw.n - 1], ' ') = g),
hit_words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names
  from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join items using (doc_id)
""",
    "op3_line_chunks": f"""
with lines as (
  select doc_id, text, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words,
    cast('0x' || substr(md5(line), 1, 15) as bigint) % {line_chunks.PRIME} as h
  from (select doc_id, text, unnest(string_split(text, chr(10))) as line,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) as i
        from documents where text is not null)),
marks as (select *, words > {line_chunks.LONG} or
    (coalesce(lag(h) over o, 0) * {line_chunks.BASE} + h) % {line_chunks.PRIME} % {line_chunks.EVERY} = 0 as ends
  from lines window o as (partition by doc_id order by i)),
placed as (select *, sum(cast(words > {line_chunks.LONG} or coalesce(before_ends, false) as integer)) over (partition by doc_id order by i) as c
  from (select *, lag(ends) over (partition by doc_id order by i) as before_ends from marks)),
chunks as (select doc_id, c, string_agg(line, chr(10) order by i) as chunk, sum(words) as words,
    count(*) filter (words > 0) as filled from placed group by 1, 2),
seen as (select doc_id, c, (words > {line_chunks.LONG} or filled >= 2 and words >= {line_chunks.LEAST})
    and row_number() over (partition by chunk order by doc_id, c) > 1 as gone from chunks),
kept as (select doc_id, string_agg(line, chr(10) order by i) filter (not gone) as text,
    count(*) filter (gone) as n_lines from placed join seen using (doc_id, c) group by 1),
gone as (select doc_id, count(*) filter (gone) as n_chunks from seen group by 1)
select d.doc_id, case when d.text is not null then coalesce(kept.text, '') end as text,
  coalesce(n_chunks, 0) as n_chunks_removed, coalesce(n_lines, 0) as n_lines_removed
from documents d left join kept using (doc_id) left join gone using (doc_id)
""",
    # equal stretches of 16 words: a run of 24 words and three periods holds one at its start and one a period later
    "op11_periodic_runs": """
with recursive crc(doc_id, left_bytes, c) as (
  select doc_id, cast(doc_id as varchar), cast(4294967295 as bigint) from documents where doc_id is not null
  union all
  select doc_id, left_bytes[2:], list_reduce(list_prepend(xor(c, ascii(left_bytes[1])), [cast(0 as bigint)] || range(1, 8)),
    lambda x, k: xor(x >> 1, (x & 1) * 3988292384)) from crc where left_bytes != ''),
coded as (select doc_id, xor(c, 4294967295) as h from crc where left_bytes = ''),
cut as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
planted as (select doc_id, w, len(w) as n, coalesce(h % 10 = 0, false) and len(w) > 0 as yes,
    coalesce(h // 10, 0) % greatest(len(w), 1) as a, 3 + coalesce(h // 10, 0) % 8 as k from cut left join coded using (doc_id)),
words as (select doc_id, i, w[case when yes and i >= a then a + (i - a) % (1 + (n - a) // k) else i end + 1] as word
  from (select doc_id, w, yes, a, k, n, unnest(range(n)) as i from planted)),
grams as (select doc_id, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 15 following) as g,
    count(*) over (partition by doc_id order by i rows between current row and 15 following) as size from words),
pairs as (select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i
  where x.size = 16 and y.size = 16),
islands as (select doc_id, q, min(i) as start, max(i) - min(i) + 16 + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as part from pairs) group by doc_id, q, part),
runs as (select doc_id, start, length, min(q) as period from islands where length >= greatest(24, 3 * q) group by 1, 2, 3),
counts as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by 1),
best as (select * from runs qualify row_number() over (partition by doc_id
  order by cast(length as hugeint) * 1000000000000000 // period desc, start, period) = 1),
dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from words anti join dropped using (doc_id, i) group by 1)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, length * 1000 // period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from documents d left join counts using (doc_id) left join best using (doc_id) left join kept using (doc_id)
""",
    "op13_seed_extend_dedup": """
with cut as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
words as (select doc_id, i, w[i + 1] as word from (select doc_id, w, unnest(range(len(w))) as i from cut)),
windows as (select doc_id, i, string_agg(word, ' ') over o as g, count(*) over o as size from words
  window o as (partition by doc_id order by i rows between current row and 19 following)),
later as (select doc_id, i from windows where size = 20 qualify row_number() over (partition by g order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from later),
kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from cut left join kept using (doc_id)
""",
    "op10_budgeted_windows": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized as (select *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')) + {chat.MARKS} as tokens,
    row_number() over (partition by conv_id order by turn, role, text) as place,
    length(role) + length(text) + length(text) - length(replace(text, '\\', '')) + 24
      + (length(replace(text, '\\', '')) - length(replace(replace(text, '\\', ''), '<|', ''))) // 2 as chars from turns),
systems as (select *, min(place) filter (role = 'system') over (partition by conv_id) as sp from sized),
strides as (select *, greatest(({chat.BUDGET} - {chat.HISTORY} - coalesce(max(tokens) filter (place = sp) over (partition by conv_id), 0)) // 2,
    {chat.MARKS}) as stride from systems),
parts as (select *, sum(large + before) over (partition by conv_id order by place) as part
  from (select *, cast(tokens > stride as integer) as large,
          coalesce(cast(lag(tokens > stride) over (partition by conv_id order by place) as integer), 0) as before from strides)),
steps as (select *, (sum(tokens) over (partition by conv_id, part order by place) - 1) // stride as step from parts),
spans as (select *, sum(fresh) over (partition by conv_id order by place) as span
  from (select *, cast(coalesce(part != lag(part) over o or step != lag(step) over o, true) as integer) as fresh
        from steps window o as (partition by conv_id order by place))),
firsts as (select conv_id, span, min(place) as f, any_value(sp) as sp from spans group by all),
history as (select f.conv_id, f.span, s.chars, s.place,
    sum(s.tokens) over (partition by f.conv_id, f.span order by s.place desc) as upto, f.sp
  from firsts f join spans s on s.conv_id = f.conv_id and s.place < f.f and s.place >= f.f - {chat.HISTORY_TURNS}),
repeated as (
  select conv_id, chars from history where upto <= {chat.HISTORY} and (sp is null or place != sp)
  union all select f.conv_id, s.chars from firsts f join spans s on s.conv_id = f.conv_id and s.place = f.sp where f.f > f.sp),
extra as (select conv_id, sum(chars) as chars from repeated group by 1),
whole as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by place) as t,
    coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '') as l, sum(chars) as chars from sized group by 1)
select conv_id, n_turns, sha256(t) as turns_sha256, length(l) as loss_chars, sha256(l) as loss_sha256,
  cast(whole.chars + coalesce(extra.chars, 0) as bigint) as formatted_chars
from whole left join extra using (conv_id)
""",
}
