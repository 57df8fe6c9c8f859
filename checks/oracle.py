"""DuckDB oracle SQL for the registered queries (tables are pre-registered
views named after the Parquet files)."""
from __future__ import annotations

import math
from typing import Dict

from checks.gen_sql import diff_masks, diff_opcodes, diff_variants, masked_rows, no_edit_rows, random_spans, encode, sample_prompts_rows, simple_rows, span_rows
from checks.sqlfrag import arr, bounds, char_ratio, h, md5key, n_words, q, u32, words
from revisio.operators.stem import sql_stems
from revisio.plans.queries import SEED
from revisio.sources.prompts import load_prompts

CAT = load_prompts()
ORACLE: Dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


EDITED = ("array_to_string(flatten(list_transform(" + words("text") + ", lambda x, i: CASE "
          + u32(md5key("'edit'", "doc_id", "i - 1")) + " % 10 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [x, x] "
          "ELSE [x] END)), ' ')")
SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
RELATED = f"(SELECT CAST(doc_id AS VARCHAR) AS row_id, {SPLIT} AS split, doc_id, text, {EDITED} AS edited FROM documents)"
CONV = """(SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS row_id, u.text AS input,
                  a.text AS output
           FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
           WHERE u.role = 'user' AND a.role = 'assistant')"""
CONV_B = f"(SELECT * FROM {CONV} cb WHERE {bounds('input', 10, 100)})"
C4 = f"(SELECT row_id, split, edited AS input, text AS output FROM {RELATED} r)"
FCE = (f"(SELECT row_id, split, edited AS text, text AS edited_text, list_slice(['x', 'y', 'z'], 1, "
       f"CAST(doc_id % 4 AS INTEGER)) AS still_need_edit FROM {RELATED} r)")
HALF = f"({n_words('text')} // 2)"
DISCO = (f"(SELECT row_id, split, array_to_string(list_slice({words('text')}, 1, {HALF}), ' ') AS "
         f"incoherent_first_sentence, array_to_string(list_slice({words('text')}, {HALF} + 1, "
         f"{n_words('text')}), ' ') AS incoherent_second_sentence, edited AS coherent_first_sentence, "
         f"'' AS coherent_second_sentence, 'and' AS connective_string, 'PAIR' AS discourse_type, "
         f"false AS has_coref_type_pronoun, false AS has_coref_type_nominal FROM {RELATED} r)")
WIKI_LARGE = f"(SELECT row_id, split, text AS input, edited AS simple FROM {RELATED} r)"
PARADETOX = (f"(SELECT row_id, split, edited AS toxic, text AS neutral1, CASE WHEN doc_id % 2 = 0 THEN NULL "
             f"ELSE text || ' indeed' END AS neutral2, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Well, ' || text "
             f"END AS neutral3 FROM {RELATED} r)")
LABEL = "CASE doc_id % 3 WHEN 0 THEN 'clarity' WHEN 1 THEN 'coherence' ELSE 'fluency' END"


def _iterater_v2() -> str:
    ew = words("edited")
    k = f"CAST({u32(md5key(chr(39) + 'span' + chr(39), 'doc_id'))} % greatest(len(ew) - 2, 1) AS INTEGER)"
    tagged = ("array_to_string(list_transform(ew, lambda x, i: CASE WHEN i - 1 = k THEN '<S>' ELSE '' END "
              "|| x || CASE WHEN i - 1 = least(k + 2, len(ew) - 1) THEN '</S>' ELSE '' END), ' ')")
    tagged = f"CASE WHEN doc_id % 5 = 0 THEN {tagged} || ' <S>more</S>' ELSE {tagged} END"
    prefix = f"CASE WHEN doc_id % 7 = 0 THEN '' ELSE '<' || {LABEL} || '>' END"
    inner = f"(SELECT *, {k} AS k FROM (SELECT *, {ew} AS ew FROM {RELATED} r0) r1)"
    return (f"(SELECT row_id, split, {prefix} || {tagged} AS before_sent_with_intent, text AS after_sent, "
            f"edited AS before_sent, {LABEL} AS labels, 0.9 AS confidence, doc_id, 1 AS revision_depth "
            f"FROM {inner} r)")


ITV2 = _iterater_v2()
SINGLE_SPAN = "len(regexp_extract_all({c}, '<S>(.*?)</S>')) = 1"


def mask_text(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda b: CASE WHEN b THEN '1' ELSE '0' END), '')"


# ---------------------------------------------------------------- sources
@oracle("read_corpus")
def _():
    return f"SELECT * FROM {C4} t WHERE split IN ('train', 'validation')"


# ------------------------------------------------------------ projections
@oracle("rename_pair")
def _():
    return f"SELECT row_id, split, text AS input, edited_text AS output FROM {FCE} t"


@oracle("drop_columns")
def _():
    return (f"SELECT row_id, split, incoherent_first_sentence, incoherent_second_sentence, "
            f"coherent_first_sentence FROM {DISCO} t")


@oracle("concat_columns")
def _():
    return (f"SELECT row_id, incoherent_first_sentence || ' ' || incoherent_second_sentence AS input, "
            f"coherent_first_sentence AS output FROM {DISCO} t")


@oracle("tag_rows")
def _():
    return f"SELECT *, 'simple' AS type, 'conversations' AS \"from\" FROM {CONV} t"


@oracle("reverse_pair")
def _():
    return f"SELECT row_id, output AS input, input AS output FROM {CONV} t"


@oracle("add_prefix")
def _():
    return f"SELECT row_id, 'summarize: ' || input AS input, output FROM {CONV} t"


@oracle("resolve_columns")
def _():
    return f"SELECT row_id, split, input, simple AS output, unnest(['position', 'map', 'name']) AS way FROM {WIKI_LARGE} t"


@oracle("rename_splits")
def _():
    return f"SELECT row_id, CASE WHEN split = 'test' THEN 'validation' ELSE split END AS split FROM {C4} t"


# ---------------------------------------------------------------- filters
@oracle("filter_word_bounds")
def _():
    return f"SELECT * FROM {CONV_B} t"


@oracle("filter_char_ratio")
def _():
    return f"SELECT row_id FROM {C4} t WHERE {char_ratio()}"


@oracle("filter_residual_edits")
def _():
    return (f"SELECT row_id, CAST(len(still_need_edit) AS INTEGER) AS residual FROM {FCE} t "
            f"WHERE len(still_need_edit) < 2")


@oracle("filter_label")
def _():
    return f"SELECT row_id, labels FROM {ITV2} t WHERE labels = 'clarity'"


@oracle("filter_not_null")
def _():
    return f"SELECT row_id FROM {PARADETOX} t WHERE neutral2 IS NOT NULL AND neutral3 IS NOT NULL"


@oracle("filter_single_span")
def _():
    return f"SELECT row_id FROM {ITV2} t WHERE {SINGLE_SPAN.format(c='before_sent_with_intent')}"


@oracle("filter_intent_prefix")
def _():
    return f"SELECT row_id FROM {ITV2} t WHERE starts_with(before_sent_with_intent, '<coherence>')"


GAPS = (f"(SELECT row_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE edited END AS input, "
        f"CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS output FROM {RELATED} r)")


@oracle("drop_empty_pairs")
def _():
    return (f"SELECT row_id FROM {GAPS} t WHERE coalesce(length(input), 0) > 0 AND "
            f"coalesce(length(output), 0) > 0")


@oracle("filter_split")
def _():
    return f"SELECT row_id, split FROM {C4} t WHERE split IN ('train', 'validation')"


# ---------------------------------------------------------------- joins
@oracle("pair_predictions")
def _():
    return f"SELECT row_id, edited AS prediction, text AS reference FROM {RELATED} r"


# ------------------------------------------------------- pair generation
def _src(x: str, inp="input", out="output") -> str:
    return f"(SELECT row_id, {inp} AS inp, {out} AS out FROM {x} sx)"


@oracle("sample_prompts")
def _():
    return (f"SELECT row_id, CAST(j AS INTEGER) AS j, prompt FROM "
            f"{sample_prompts_rows(_src(CONV), CAT['gec'], 3, SEED, 'q')} t")


@oracle("simple_pairs")
def _():
    return f"SELECT * FROM {simple_rows(_src(CONV_B), CAT['gec'], 2, SEED, 'q')} t"


@oracle("masked_pairs")
def _():
    return f"SELECT * FROM {masked_rows(_src(CONV), CAT['gec'], 4, SEED, 'q')} t"


@oracle("no_edit_pairs")
def _():
    return f"SELECT * FROM {no_edit_rows(_src(CONV), CAT['do_not_edit'], 300, SEED, 'q')} t"


@oracle("span_annotated_pairs")
def _():
    src = _src(ITV2, "before_sent_with_intent", "after_sent")
    return f"SELECT * FROM {span_rows(src, 'clarity', CAT['simplification'], 3, SEED, 'q')} t"


def edit_rows(src: str, prompts, repeat: int, V: int, seed: int, stream: str, diff: bool = False) -> str:
    """Plain + masked rows with ``type`` (the fused generator)."""
    return (f"(SELECT *, 'simple' AS type FROM {simple_rows(src, prompts, repeat, seed, stream)} a "
            f"UNION ALL SELECT *, 'mask' AS type FROM {masked_rows(src, prompts, V, seed, stream, diff=diff)} b)")


@oracle("bidirectional_pairs")
def _():
    fwd = edit_rows(_src(CONV_B), CAT["formality"], 1, 2, SEED, "q/fwd")
    rev = edit_rows(_src(CONV_B, "output", "input"), CAT["formality_rev"], 1, 2, SEED, "q/rev")
    return f"SELECT *, 'formal' AS \"from\" FROM {fwd} f UNION ALL SELECT *, 'informal' AS \"from\" FROM {rev} r"


@oracle("alternatives_unpivot")
def _():
    return " UNION ALL ".join(f"SELECT row_id || ':{c}' AS row_id, toxic AS input, {c} AS output FROM {PARADETOX} t WHERE {c} IS NOT NULL"
                              for c in ("neutral1", "neutral2", "neutral3"))


# ---------------------------------------------------------------- masks
REL_WORDS = f"(SELECT row_id, {words('text')} AS a, {words('edited')} AS b FROM {RELATED} r)"


@oracle("diff_opcodes")
def _():
    return f"SELECT row_id, k::INTEGER AS k, tag, i1::INTEGER AS i1, i2::INTEGER AS i2, j1::INTEGER AS j1, j2::INTEGER AS j2 FROM {diff_opcodes(REL_WORDS)} o"


@oracle("mask_diff_full")
def _():
    return f"SELECT row_id, {mask_text('mask')} AS mask FROM {diff_masks(REL_WORDS)} m"


@oracle("mask_diff_single_run")
def _():
    m = "list_transform(range(len(w)), lambda p: p >= spans[1].st AND p < spans[1].st + spans[1].ln)"
    src = f"(SELECT row_id, edited AS inp, text AS out FROM {RELATED} r)"
    return f"SELECT row_id, vname AS variant, {mask_text(m)} AS mask FROM {diff_variants(src, SEED, 'q')} v WHERE vname <> 'd0'"


RAND_VARIANTS = random_spans(SEED, "q", 4, f"(SELECT row_id, input AS inp, {words('output')} AS w FROM {CONV} c)")
RAND_MASK = (f"(SELECT row_id, vname, w, spans, list_transform(range(len(w)), lambda p: "
             f"len(list_filter(spans, lambda sp: p >= sp.st AND p < sp.st + sp.ln)) > 0) AS m FROM {RAND_VARIANTS} v)")


@oracle("mask_random_spans")
def _():
    return f"SELECT row_id, vname AS variant, {mask_text('m')} AS mask FROM {RAND_MASK} t"


@oracle("mask_protect_words")
def _():
    prot = "list_transform(m, lambda b, i: b AND NOT list_contains([0, 1, 2, 99], i - 1))"
    return f"SELECT row_id, vname AS variant, {mask_text(prot)} AS mask FROM {RAND_MASK} t"


@oracle("encode_sentinels")
def _():
    return f"SELECT row_id, vname AS variant, masked FROM {encode(RAND_VARIANTS)} t"


@oracle("encode_targets")
def _():
    return f"SELECT row_id, vname AS variant, target FROM {encode(RAND_VARIANTS)} t"


# ------------------------------------------------- order, limits, splits
@oracle("union_splits")
def _():
    return f"SELECT row_id, split FROM {FCE} t WHERE split IN ('train', 'validation', 'test')"


@oracle("union_examples")
def _():
    src = _src(CONV_B)
    return (f"SELECT *, 'simple' AS type FROM {simple_rows(src, CAT['gec'], 1, SEED, 'q')} a UNION ALL "
            f"SELECT *, 'mask' AS type FROM {masked_rows(src, CAT['gec'], 2, SEED, 'q')} b UNION ALL "
            f"SELECT *, 'no edit' AS type FROM {no_edit_rows(src, CAT['do_not_edit'], 5000, SEED, 'qn')} c")


DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS row_id, lang FROM documents)"
SHUF = h(SEED, "shuffle", "row_id", "sh")


@oracle("shuffle_rows")
def _():
    return f"SELECT row_id, lang, row_number() OVER (ORDER BY {SHUF}, row_id) - 1 AS position FROM {DOCS} d"


@oracle("head_rows")
def _():
    return "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100"


@oracle("capped_sample")
def _():
    return f"SELECT row_id, lang FROM {DOCS} d ORDER BY {SHUF}, row_id LIMIT 100"


@oracle("slice_rows")
def _():
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    return (f"SELECT * FROM (SELECT {key}, l_quantity, row_number() OVER (ORDER BY {key}) - 1 AS rank FROM lineitem) t "
            "WHERE rank >= 40000 AND rank < 40300")


@oracle("train_fraction")
def _():
    key = h(1337, "split", "row_id", "tr")
    return (f"SELECT row_id, lang FROM (SELECT *, row_number() OVER (ORDER BY {key}, row_id) - 1 AS r, "
            f"count(*) OVER () AS n FROM {DOCS} d) t WHERE r < floor(0.95 * n)")


@oracle("global_rank")
def _():
    key = md5key("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return (f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY {key}) - 1 AS rank "
            f"FROM lineitem")


@oracle("sample_one")
def _():
    return f"SELECT row_id, lang FROM {DOCS} d ORDER BY {SHUF}, row_id LIMIT 1"


@oracle("flagship")
def _():
    return (f"SELECT *, 'simple' AS type, 'conversations' AS \"from\" FROM "
            f"{simple_rows(_src(CONV_B), CAT['gec'], 2, SEED, 'q')} t")


# ---------------------------------------------------------------- recipes
GYAFC = (f"(SELECT row_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 2 = 1 THEN 'family_train' "
         f"ELSE 'ent_train' END AS split, edited AS informal, text AS formal FROM {RELATED} r)")
WIKI_AUTO = f"(SELECT row_id, split, text AS normal, edited AS simple FROM {RELATED} r)"
PARABANK = f"(SELECT row_id, split, text AS input_text, edited AS paraphrased_text FROM {RELATED} r)"
ITV1 = (f"(SELECT row_id, CASE WHEN doc_id % 10 = 0 THEN 'human_validation' WHEN doc_id % 10 = 1 THEN "
        f"'full_validation' ELSE 'train' END AS split, edited AS input, text AS output, {LABEL} AS task "
        f"FROM {RELATED} r)")


def fraction(src: str, frac: float = 0.95, seed: int = 1337) -> str:
    key = h(seed, "split", "row_id", "tr")
    return (f"(SELECT row_id, inp, out FROM (SELECT *, row_number() OVER (ORDER BY {key}, row_id) - 1 AS r_, "
            f"count(*) OVER () AS n_ FROM {src} f0) f1 WHERE r_ < floor({frac} * n_))")


def standard_recipe(key: str, tag: str, group: str, base: str, repeat: int, V: int,
                    rev_group: str = None, rev_tag: str = None, diff: bool = False) -> str:
    parts = [f"SELECT *, '{tag}' AS \"from\" FROM {edit_rows(base, CAT[group], repeat, V, SEED, key + '/fwd', diff)} a"]
    if rev_group:
        rbase = f"(SELECT row_id, out AS inp, inp AS out FROM {base} rb)"
        parts.append(f"SELECT *, '{rev_tag}' AS \"from\" FROM "
                     f"{edit_rows(rbase, CAT[rev_group], repeat, V, SEED, key + '/rev')} b")
    parts.append(f"SELECT *, 'no edit' AS type, '{tag}' AS \"from\" FROM "
                 f"{no_edit_rows(base, CAT['do_not_edit'], 5000, SEED, key + '/noedit')} c")
    return " UNION ALL ".join(parts)


@oracle("gyafc")
def _():
    base = (f"(SELECT row_id, informal AS inp, formal AS out FROM {GYAFC} g "
            f"WHERE split IN ('ent_train', 'family_train') AND {bounds('informal', 7, 70)})")
    return standard_recipe("gyafc", "gyafc_formal", "formality", base, 1, 5, "formality_rev", "gyafc_informal")


@oracle("disco_fuse")
def _():
    base = (f"(SELECT row_id, incoherent_first_sentence || ' ' || incoherent_second_sentence AS inp, "
            f"coherent_first_sentence AS out FROM {DISCO} d WHERE split = 'train' AND "
            f"{bounds('incoherent_first_sentence', 8)} AND {bounds('incoherent_second_sentence', 8)})")
    return standard_recipe("disco_fuse", "disco_fuse_coh", "coherence", fraction(base), 1, 4)


@oracle("wiki_auto")
def _():
    base = (f"(SELECT row_id, normal AS inp, simple AS out FROM {WIKI_AUTO} w WHERE split = 'train' AND "
            f"{bounds('normal', 10, 400)} AND {bounds('simple', 10, 400)})")
    return standard_recipe("wiki_auto", "wiki_auto_simplicity", "simplification", base, 1, 3)


@oracle("wiki_large")
def _():
    base = (f"(SELECT row_id, input AS inp, simple AS out FROM {WIKI_LARGE} w WHERE split = 'train' AND "
            f"{bounds('input', 20, 100)} AND {bounds('simple', 15, 100)})")
    return standard_recipe("wiki_large", "wiki_large_simplicity", "simplification", base, 1, 2)


@oracle("para_bank_v2")
def _():
    base = f"(SELECT row_id, input_text AS inp, paraphrased_text AS out FROM {PARABANK} p WHERE split = 'train')"
    return standard_recipe("para_bank_v2", "parabank_paraphrase", "paraphrasing", fraction(base), 1, 5)


def _diff_recipe(key: str, tag: str, group: str, source: str, inp: str, out: str, where: str, repeat: int, V: int, part: bool = False) -> None:
    base = f"(SELECT row_id, {inp} AS inp, {out} AS out FROM {source} t WHERE {where})"
    ORACLE[key] = standard_recipe(key, tag, group, fraction(base) if part else base, repeat, V, diff=True)


WNC = f"(SELECT row_id, split, edited AS text, text AS edited_text FROM {RELATED} r)"
TRAIN, TRAIN_VAL = "split = 'train'", "split IN ('train', 'validation')"
_diff_recipe("c4_gec", "c4_gec", "gec", C4, "input", "output", f"{TRAIN} AND {bounds('input', 10, 100)} AND {char_ratio()}", 1, 2)
_diff_recipe("fce_gec", "fce_gec", "gec", FCE, "text", "edited_text",
             f"split IN ('train', 'validation', 'test') AND len(still_need_edit) = 0 AND {bounds('text', None, 300)}", 3, 10)
_diff_recipe("lang8", "clang8_gec", "gec", C4, "input", "output", f"{TRAIN} AND {bounds('input', 12, 50)}", 1, 1)
_diff_recipe("bea19", "bea19_gec", "gec", FCE, "text", "edited_text", f"{TRAIN_VAL} AND {bounds('text', None, 350)} AND len(still_need_edit) < 2", 2, 10)
_diff_recipe("wnc", "wnc_neut", "neutralization", WNC, "text", "edited_text", TRAIN_VAL, 1, 5, part=True)
_diff_recipe("APPDIA_offensive", "appdia_offensive", "offensive", WNC, "text", "edited_text", TRAIN_VAL, 1, 5)


def _paradetox() -> str:
    rows = f"(SELECT row_id, toxic AS inp, row_id AS out FROM {PARADETOX} t WHERE {TRAIN} AND {bounds('toxic', 6)} AND {bounds('neutral1', 6)})"
    parts = " UNION ALL ".join(f"SELECT p.row_id || ':{c}' AS row_id, p.toxic AS inp, p.{c} AS out FROM {PARADETOX} p JOIN {fraction(rows)} f "
                               f"ON f.row_id = p.row_id WHERE p.{c} IS NOT NULL" for c in ("neutral1", "neutral2", "neutral3"))
    return standard_recipe("Paradetox_toxic", "paradetox_toxic", "toxic", f"({parts})", 1, 3, diff=True)


ORACLE["Paradetox_toxic"] = _paradetox()


def _v2(key: str, kind: str, group: str, repeat: int) -> str:
    base = (f"(SELECT row_id, before_sent_with_intent AS inp, after_sent AS out FROM {ITV2} i "
            f"WHERE split = 'train' AND labels = '{kind}' AND {bounds('before_sent_with_intent', 10)} AND "
            f"{bounds('after_sent', 10)} AND {SINGLE_SPAN.format(c='before_sent_with_intent')})")
    return (f"SELECT *, 'mask' AS type, 'IteraTeRV2_{kind}' AS \"from\" FROM "
            f"{span_rows(base, kind, CAT[group], repeat, SEED, key + '/span')} s")


def _v1(key: str, kind: str, group: str, repeat: int) -> str:
    base = (f"(SELECT row_id, input AS inp, output AS out FROM {ITV1} i WHERE split IN "
            f"('train', 'human_validation', 'full_validation') AND task = '{kind}')")
    return standard_recipe(key, f"IteraTerV1_{kind}", group, base, repeat, 4)


for _key, _kind, _group, _rep in [("IteraTeR_Simplicity", "clarity", "simplification", 3),
                                  ("IteraTeR_Coherence", "coherence", "coherence", 4),
                                  ("IteraTeR_Fluency", "fluency", "gec", 3)]:
    ORACLE[_key] = _v2(_key, _kind, _group, _rep)
for _key, _kind, _group, _rep in [("IteraTeR_V1_Simplicity", "clarity", "simplification", 3),
                                  ("IteraTeR_V1_Coherence", "coherence", "coherence", 4),
                                  ("IteraTeR_V1_Fluency", "fluency", "gec", 3)]:
    ORACLE[_key] = _v1(_key, _kind, _group, _rep)

# Every recipe; a new one without its SQL here would fail.
from revisio.plans.recipes import RECIPES  # noqa: E402

ORACLE["mixture"] = " UNION ALL ".join(f'SELECT row_id, variant, input, output, type, "from" FROM ({ORACLE[k]}) m{i}' for i, k in enumerate(RECIPES))
ORACLE["build_all"] = ORACLE["mixture"]


# ------------------------------------------------- tokenise, pad, batch
VOCAB = ("(SELECT token, count, CAST(id AS INTEGER) AS id FROM (SELECT token, count, row_number() OVER "
         "(ORDER BY count DESC, token) - 1 + 3 AS id FROM (SELECT token, count(*) AS count FROM (SELECT unnest("
         + words("text") + ") AS token FROM documents) t GROUP BY token) c) v WHERE id < 5000)")


def _tok_side(col: str, side: int, max_len: int) -> str:
    sl = f"list_slice({words(col)}, 1, {max_len - 1})"
    return f"SELECT row_id, {side} AS side, unnest({sl}) AS token, generate_subscripts({sl}, 1) AS pos FROM {RELATED} r"


TOK = (f"(SELECT t.row_id, t.side, t.pos, coalesce(v.id, 2) AS id FROM ({_tok_side('edited', 0, 128)} UNION ALL "
       f"{_tok_side('text', 1, 64)}) t LEFT JOIN {VOCAB} v ON v.token = t.token)")
TOKD = (f"(SELECT rr.row_id, list_concat(coalesce(a.ids, []::INTEGER[]), [1]) AS input_ids, "
        f"list_concat(coalesce(b.ids, []::INTEGER[]), [1]) AS labels FROM (SELECT CAST(doc_id AS VARCHAR) AS row_id "
        f"FROM documents) rr "
        f"LEFT JOIN (SELECT row_id, list(CAST(id AS INTEGER) ORDER BY pos) AS ids FROM {TOK} t0 WHERE side = 0 "
        f"GROUP BY row_id) a ON a.row_id = rr.row_id "
        f"LEFT JOIN (SELECT row_id, list(CAST(id AS INTEGER) ORDER BY pos) AS ids FROM {TOK} t1 WHERE side = 1 "
        f"GROUP BY row_id) b ON b.row_id = rr.row_id)")


def ids(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: CAST(x AS VARCHAR)), ' ')"


def pad(c: str, n: str, v: int = 0) -> str:
    return f"list_concat({c}, list_transform(range(greatest(({n}) - len({c}), 0)), lambda _z: {v}))"


LABELS = f"(SELECT row_id, list_transform({pad('labels', '64')}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels FROM {TOKD} t)"


@oracle("build_vocab")
def _():
    return f"SELECT * FROM {VOCAB} v"


@oracle("tokenize_truncate")
def _():
    return f"SELECT row_id, {ids('input_ids')} AS input_ids, {ids('labels')} AS labels FROM {TOKD} t"


@oracle("pad_to_length")
def _():
    att = f"list_concat(list_transform(input_ids, lambda x: 1), list_transform(range(greatest(128 - len(input_ids), 0)), lambda _z: 0))"
    return f"SELECT row_id, {ids(pad('input_ids', '128'))} AS input_ids, {ids(att)} AS attention_mask FROM {TOKD} t"


@oracle("mask_label_padding")
def _():
    return f"SELECT row_id, {ids('labels')} AS labels FROM {LABELS} l"


@oracle("unmask_label_padding")
def _():
    un = "list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)"
    return f"SELECT row_id, {ids(un)} AS labels FROM {LABELS} l"


@oracle("shift_right")
def _():
    sh = ("list_transform(list_concat([0], list_slice(labels, 1, len(labels) - 1)), "
          "lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)")
    return f"SELECT row_id, {ids(sh)} AS decoder_input_ids FROM {LABELS} l"


@oracle("decoder_attention_mask")
def _():
    m = "list_transform(labels, lambda x: CASE WHEN x = 0 OR x = -100 THEN 0 ELSE 1 END)"
    return f"SELECT row_id, {ids(m)} AS decoder_attention_mask FROM {LABELS} l"


def ranked(src: str) -> str:
    key = h(SEED, "batch", "row_id", "sh")
    return f"(SELECT *, row_number() OVER (ORDER BY {key}, row_id) - 1 AS rk, count(*) OVER () AS n FROM {src} s)"


def batches(src: str, mode: str, bs: int) -> str:
    if mode == "drop_last":
        inner = f"(SELECT *, rk // {bs} AS batch_id FROM {ranked(src)} r WHERE rk < (n // {bs}) * {bs})"
    elif mode == "fixed":
        inner = f"(SELECT *, rk // {bs} AS batch_id FROM {ranked(src)} r)"
    else:
        inner = (f"(SELECT *, CASE WHEN rk < rem * (q + 1) THEN rk // (q + 1) ELSE rem + (rk - rem * (q + 1)) // q "
                 f"END AS batch_id FROM (SELECT *, n - q * steps AS rem FROM (SELECT *, n // steps AS q FROM "
                 f"(SELECT *, CAST(ceil(n / {bs}) AS BIGINT) AS steps FROM {ranked(src)} r) a) b) c)")
    return f"(SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY rk) - 1 AS pos_in_batch FROM {inner} i)"


for _mode in ("drop_last", "even", "fixed"):
    ORACLE[f"assign_batches_{_mode}"] = (f"SELECT row_id, CAST(batch_id AS BIGINT) AS batch_id, "
                                         f"CAST(pos_in_batch AS INTEGER) AS pos_in_batch "
                                         f"FROM {batches(DOCS, _mode, 7)} b")


@oracle("collate_padded")
def _():
    longest = "CAST(ceil(max(len({c})) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER)"
    inner = (f"(SELECT CAST(batch_id AS BIGINT) AS batch_id, pos_in_batch, input_ids, labels, {longest.format(c='input_ids')} AS pad_len, "
             f"{longest.format(c='labels')} AS label_len FROM {batches(TOKD, 'drop_last', 8)} x)")
    sides = {"input_ids": pad("input_ids", "pad_len"), "attention_mask": pad("list_transform(input_ids, lambda x: 1)", "pad_len"),
             "labels": pad("labels", "label_len", -100)}
    joined = ", ".join(f"string_agg({ids(v)}, '|' ORDER BY pos_in_batch) AS {n}" for n, v in sides.items())
    return f"SELECT batch_id, {joined} FROM {inner} y GROUP BY batch_id"


@oracle("pad_batches")
def _():
    b = batches(TOKD, "fixed", 8)
    longest = "CAST(ceil(max(len({c})) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER)"
    inner = (f"(SELECT row_id, CAST(batch_id AS BIGINT) AS batch_id, input_ids, labels, {longest.format(c='input_ids')} AS pad_len, "
             f"{longest.format(c='labels')} AS label_len FROM {b} x)")
    att = pad("list_transform(input_ids, lambda x: 1)", "pad_len")
    return (f"SELECT row_id, batch_id, pad_len, label_len, {ids(pad('input_ids', 'pad_len'))} AS input_ids, {ids(att)} AS attention_mask, "
            f"{ids(pad('labels', 'label_len', -100))} AS labels FROM {inner} y")


def prepared_sql(start: int) -> str:
    rows = (f"(SELECT row_id, 'fix: ' || input AS input, output FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS rk FROM {GAPS} g) s "
            f"WHERE rk >= {start} AND coalesce(length(input), 0) > 0 AND coalesce(length(output), 0) > 0)")

    def side(col: str, most: int) -> str:
        cut = f"list_slice({words(col)}, 1, {most - 1})"
        toks = f"(SELECT row_id, unnest({cut}) AS token, generate_subscripts({cut}, 1) AS pos FROM {rows} r)"
        return (f"(SELECT t.row_id, list(CAST(coalesce(v.id, 2) AS INTEGER) ORDER BY pos) AS ids FROM {toks} t LEFT JOIN {VOCAB} v "
                f"ON v.token = t.token GROUP BY t.row_id)")

    tokens = (f"(SELECT r.row_id, list_concat(coalesce(a.ids, []::INTEGER[]), [1]) AS input_ids, list_concat(coalesce(b.ids, []::INTEGER[]), [1]) AS labels "
              f"FROM {rows} r LEFT JOIN {side('input', 128)} a ON a.row_id = r.row_id LEFT JOIN {side('output', 64)} b ON b.row_id = r.row_id)")
    longest = "CAST(ceil(max(len({c})) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER)"
    inner = (f"(SELECT row_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(pos_in_batch AS INTEGER) AS pos_in_batch, input_ids, labels, "
             f"{longest.format(c='input_ids')} AS pad_len, {longest.format(c='labels')} AS label_len FROM {batches(tokens, 'drop_last', 8)} x)")
    return (f"SELECT row_id, batch_id, pos_in_batch, pad_len, label_len, {ids(pad('input_ids', 'pad_len'))} AS input_ids, "
            f"{ids(pad('labels', 'label_len', -100))} AS labels FROM {inner} y")


ORACLE["prepare"] = prepared_sql(0)
ORACLE["prepare_all"] = prepared_sql(10)


@oracle("batch_plan")
def _():
    return ("SELECT count(*) AS examples, CAST(floor(count(*) / 64) AS BIGINT) AS steps_per_epoch, "
            "CAST(floor(count(*) / 64) * 3 AS BIGINT) AS total_steps, 64 AS total_batch_size FROM documents")


@oracle("collate")
def _():
    return (f"SELECT CAST(batch_id AS BIGINT) AS batch_id, string_agg(row_id, ',' ORDER BY pos_in_batch) AS row_ids "
            f"FROM {batches(DOCS, 'fixed', 7)} b GROUP BY batch_id")


# ---------------------------------------------------------------- metrics
from revisio.functions.text import WS_CLASS  # noqa: E402

def strip_sql(c: str) -> str:
    return "regexp_replace(" + c + ", " + q(f"^{WS_CLASS}+|{WS_CLASS}+$") + ", '', 'g')"


@oracle("clean_text")
def _():
    return f"SELECT row_id, {strip_sql('edited')} AS prediction FROM {RELATED} r"


@oracle("split_sentences")
def _():
    return (f"SELECT row_id, regexp_replace({strip_sql('text')}, {q('([.!?])' + WS_CLASS + '+')}, "
            f"'\\1' || chr(10), 'g') AS reference FROM {RELATED} r")


def abbreviation_sql() -> str:
    """word, with_stop, without_stop, score."""
    typed = f"(SELECT lower(regexp_replace(w, '\\.$', '')) AS word, ends_with(w, '.') AS stop FROM (SELECT unnest({words('text')}) AS w FROM documents) t)"
    counts = f"(SELECT word, count(*) FILTER (stop) AS k, count(*) FILTER (NOT stop) AS m FROM {typed} t GROUP BY word)"
    totals = f"(SELECT least(sum(k)::DOUBLE / sum(k + m)::DOUBLE, 1 - 1e-9) AS p FROM {counts} c0)"
    inner = "(length(word) - length(replace(word, '.', '')))"
    ratio = "-2 * ((k * ln(p) + m * ln(1 - p)) - (k * ln(0.99::DOUBLE) + m * ln(1 - 0.99::DOUBLE)))"
    score = f"{ratio} * exp(-(length(word) - {inner})) * ({inner} + 1) * pow((length(word) - {inner})::DOUBLE, -m::DOUBLE)"
    return (f"(SELECT word, k AS with_stop, m AS without_stop, {score} AS score FROM {counts} c, {totals} z "
            "WHERE k > 0 AND regexp_matches(word, '[a-zA-Z\\p{L}]'))")


@oracle("abbreviations")
def _():
    return f"SELECT word, with_stop, without_stop, round(score, 6) + 0.0 AS score, score >= 0.3 AS abbreviation FROM {abbreviation_sql()} a"


@oracle("split_sentences_learned")
def _():
    ws = q(WS_CLASS + "+")
    marked = f"regexp_replace(replace({strip_sql('text')}, chr(1), ' '), {q('([.!?])(' + WS_CLASS + '+)')}, '\\1' || chr(1) || '\\2', 'g')"
    last = f"regexp_extract(parts[i - 1], {q('([^' + WS_CLASS[1:-1] + ']+)$')}, 1)"
    known = f"(SELECT list(word) AS ws FROM {abbreviation_sql()} a WHERE score >= 0.3)"
    joined = (f"array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 OR (ends_with({last}, '.') AND "
              f"list_contains(ws, lower(regexp_replace({last}, '\\.$', '')))) THEN x ELSE chr(10) || regexp_replace(x, '^' || {ws}, '') END), '')")
    return (f"SELECT row_id, {joined} AS sentences FROM (SELECT row_id, string_split({marked}, chr(1)) AS parts FROM {RELATED} r) p, "
            f"(SELECT coalesce(ws, []::VARCHAR[]) AS ws FROM {known} k0) k")


@oracle("decode_ids")
def _():
    ex = f"(SELECT row_id, unnest(labels) AS id, generate_subscripts(labels, 1) AS pos FROM {TOKD} t)"
    agg = (f"(SELECT e.row_id, string_agg(v.token, ' ' ORDER BY e.pos) AS text FROM {ex} e JOIN {VOCAB} v "
           f"ON v.id = e.id WHERE e.id >= 3 GROUP BY e.row_id)")
    return (f"SELECT rr.row_id, coalesce(a.text, '') AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS row_id FROM "
            f"documents) rr LEFT JOIN {agg} a ON a.row_id = rr.row_id")


def grams(tok: str, n: int) -> str:
    return (f"list_transform(range(0, greatest(len({tok}) - {n} + 1, 0)), lambda i: "
            f"array_to_string(list_slice({tok}, i + 1, i + {n}), ' '))")


def gram_counts(tok_expr: str, orders) -> str:
    parts = []
    for n in orders:
        for side, col in ((1, "edited"), (2, "text")):
            parts.append(f"SELECT row_id, {n} AS n, unnest({grams('tk', n)}) AS g, {side} AS s FROM "
                         f"(SELECT row_id, {tok_expr(col)} AS tk FROM {RELATED} r) x")
    return (f"(SELECT row_id, n, g, CAST(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c_h, "
            f"CAST(sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS BIGINT) AS c_r FROM ({' UNION ALL '.join(parts)}) u "
            f"GROUP BY row_id, n, g)")


def BLEU_TOK(c: str) -> str:
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, {q(old)}, {q(new)})"
    c = f"' ' || {c} || ' '"
    for pattern, new in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'g')"
    return words(c)


def ROUGE_TOK(c: str) -> str:
    return words("regexp_replace(lower(" + c + "), '[^a-z0-9]+', ' ', 'g')")


LEVEL = ("CASE WHEN grouping(d.source) = 0 THEN 'from' WHEN grouping(d.lang) = 0 THEN 'type' ELSE 'all' END AS level, "
         "d.source AS \"from\", d.lang AS type")
LEVELS = "GROUP BY GROUPING SETS ((d.source), (d.lang), ())"
BY = 'level, "from", type'


def with_document(rows: str) -> str:
    return f"{rows} g JOIN documents d ON CAST(d.doc_id AS VARCHAR) = g.row_id"


def bleu_sql(by: bool = False) -> str:
    g = gram_counts(BLEU_TOK, range(1, 5))
    sums = ", ".join(f"CAST(sum(CASE WHEN n = {n} THEN least(c_h, c_r) ELSE 0 END) AS BIGINT) AS m{n}, "
                     f"CAST(sum(CASE WHEN n = {n} THEN c_h ELSE 0 END) AS BIGINT) AS t{n}" for n in range(1, 5))
    s = f"(SELECT {sums}, CAST(sum(CASE WHEN n = 1 THEN c_r ELSE 0 END) AS BIGINT) AS ref_len FROM {g} g)"
    if by:
        s = s.replace("(SELECT ", f"(SELECT {LEVEL}, ", 1)[:-len(f"{g} g)")] + f"{with_document(g)} {LEVELS})"
    z, logs = "0", []
    for n in range(1, 5):
        z = f"({z} + CASE WHEN m{n} = 0 AND t{n} > 0 THEN 1 ELSE 0 END)"
        p = (f"(CASE WHEN t{n} = 0 THEN 0.0 WHEN m{n} > 0 THEN 100.0 * m{n} / t{n} "
             f"ELSE 100.0 / (pow(2.0, {z}) * t{n}) END)")
        logs.append(f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999.0 END)")
    bp = "(CASE WHEN t1 >= ref_len THEN 1.0 WHEN t1 > 0 THEN exp(1 - ref_len / t1) ELSE 0.0 END)"
    return (f"SELECT {BY + ', ' if by else ''}CASE WHEN m1 + m2 + m3 + m4 = 0 THEN 0.0 ELSE round_even({bp} * exp(({' + '.join(logs)}) / 4), 4) END AS bleu, m1, m2, m3, m4, t1, t2, t3, t4, "
            f"t1 AS hyp_len, ref_len FROM {s} s")


def rouge_rows(tok=ROUGE_TOK) -> str:
    """row_id, f1, f2: each row's F1."""
    g = gram_counts(tok, (1, 2))
    per = ", ".join(f"sum(CASE WHEN n = {n} THEN least(c_h, c_r) ELSE 0 END) AS o{n}, "
                    f"sum(CASE WHEN n = {n} THEN c_h ELSE 0 END) AS h{n}, "
                    f"sum(CASE WHEN n = {n} THEN c_r ELSE 0 END) AS r{n}" for n in (1, 2))
    rows = (f"(SELECT rr.row_id, a.* EXCLUDE (row_id) FROM (SELECT CAST(doc_id AS VARCHAR) AS row_id FROM documents) rr "
            f"LEFT JOIN (SELECT row_id, {per} FROM {g} g GROUP BY row_id) a ON a.row_id = rr.row_id)")
    fs = []
    for n in (1, 2):
        p = f"(coalesce(o{n}, 0) / greatest(coalesce(h{n}, 0), 1))"
        r = f"(coalesce(o{n}, 0) / greatest(coalesce(r{n}, 0), 1))"
        fs.append(f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END AS f{n}")
    return f"(SELECT row_id, {', '.join(fs)} FROM {rows} x)"


ROUGE_MEANS = ", ".join(f"round_even(avg(f{n}) * 100, 4) AS rouge{n}" for n in (1, 2))


def rouge_sql() -> str:
    return f"SELECT {ROUGE_MEANS} FROM {rouge_rows()} x"


def intervals_sql(replicates: int) -> str:
    share, cumulative, weight = math.exp(-1), 0.0, []
    for k in range(1, 13):  # Poisson(1) by its cumulative probabilities
        cumulative += share
        weight.append(f"CASE WHEN u >= {int(cumulative * (1 << 32))} THEN 1 ELSE 0 END")
        share /= k
    draws = f"(SELECT f1, f2, b, {u32(h(SEED, 'boot', 'row_id', 'pw', 'b'))} AS u FROM {rouge_rows()} x, range({replicates}) t(b))"
    weighed = f"(SELECT f1, f2, b, {' + '.join(weight)} AS w FROM {draws} y)"
    sums = ", ".join(f"coalesce(CAST(sum(w * CAST(round(f{n} * 1e12) AS HUGEINT)) AS DOUBLE) / nullif(sum(w), 0) / 1e12, 0.0) AS m{n}" for n in (1, 2))
    means = f"(SELECT b, {sums} FROM {weighed} z GROUP BY b)"
    rows = [f"SELECT 'rouge{n}' AS metric, " + ", ".join(f"round_even(quantile_cont(m{n}, {p}) * 100, 4) AS {c}" for c, p in
                                                         (("low", (1 - 0.95) / 2), ("mid", 0.5), ("high", 1 - (1 - 0.95) / 2))) + f" FROM {means} v"
            for n in (1, 2)]
    return " UNION ALL ".join(rows)


def levels_sql() -> str:
    rouge = f"(SELECT {LEVEL}, {ROUGE_MEANS} FROM {with_document(rouge_rows())} {LEVELS})"
    lens = f"(SELECT {LEVEL}, round_even(avg(len(g.input_ids)), 4) AS gen_len FROM {with_document(TOKD)} {LEVELS})"
    return " UNION ALL ".join([f"SELECT {BY}, 'bleu' AS metric, bleu AS value FROM ({bleu_sql(True)}) b",
                               *[f"SELECT {BY}, 'rouge{n}', rouge{n} FROM {rouge} r" for n in (1, 2)],
                               f"SELECT {BY}, 'gen_len', gen_len FROM {lens} l"])


def rouge_l_sql() -> str:
    """The longest common subsequence by bits: the reference's places in words of
    60 bits; for each predicted token one addition over the words, with carry.
    Zero bits that are left are matches."""
    word = (1 << 60) - 1
    toks = f"(SELECT row_id, {ROUGE_TOK('edited')} AS a, {ROUGE_TOK('text')} AS b FROM {RELATED} r)"
    bits = ("(SELECT row_id, tok, (pos - 1) // 60 AS k, bit_or(CAST(1 AS UBIGINT) << CAST((pos - 1) % 60 AS UBIGINT)) AS m FROM "
            "(SELECT row_id, unnest(b) AS tok, generate_subscripts(b, 1) AS pos FROM t) x GROUP BY row_id, tok, (pos - 1) // 60)")
    maps = f"(SELECT row_id, tok, map_from_entries(list((k, m))) AS mp FROM {bits} y GROUP BY row_id, tok)"
    masks = f"(SELECT z.row_id, tok, list_transform(range((len(b) + 59) // 60), lambda k: coalesce(mp[k], CAST(0 AS UBIGINT))) AS ms FROM {maps} z JOIN t USING (row_id))"
    steps = (f"(SELECT row_id, list(ms ORDER BY pos) AS steps FROM (SELECT row_id, unnest(a) AS tok, generate_subscripts(a, 1) AS pos FROM t) q "
             f"JOIN {masks} w USING (row_id, tok) GROUP BY row_id)")
    start = (f"list_transform(range((len(b) + 59) // 60), lambda k: CASE WHEN (k + 1) * 60 <= len(b) THEN CAST({word} AS UBIGINT) "
             "ELSE (CAST(1 AS UBIGINT) << CAST(len(b) - k * 60 AS UBIGINT)) - 1 END)")
    total = "(v[k] + (v[k] & m[k]) + acc.c)"
    chunk = (f"{{'c': {total} >> CAST(60 AS UBIGINT), 'o': list_append(acc.o, (({total} & CAST({word} AS UBIGINT)) | (v[k] - (v[k] & m[k]))) & ones[k])}}")
    fold = (f"list_reduce(steps, lambda v, m: (list_reduce(range(1, len(v) + 1), lambda acc, k: {chunk}, "
            "{'c': CAST(0 AS UBIGINT), 'o': CAST([] AS UBIGINT[])})).o, ones)")
    rows = f"(SELECT t.row_id, len(a) AS n, len(b) AS m, steps, {start} AS ones FROM t LEFT JOIN {steps} s ON s.row_id = t.row_id)"
    lcs = f"(SELECT n, m, CASE WHEN steps IS NULL THEN 0 ELSE m - list_sum(list_transform({fold}, lambda x: bit_count(x))) END AS hits FROM {rows} u)"
    return (f"WITH t AS {toks} SELECT round_even(avg(CASE WHEN hits > 0 THEN 2 * hits / (n + m) ELSE 0.0 END) * 100, 4) AS \"rougeL\" FROM {lcs} l")


ORACLE["rouge_l"] = rouge_l_sql()
ORACLE["score_levels"] = levels_sql()
ORACLE["rouge_intervals"] = intervals_sql(1000)
ORACLE["rouge_stemmed"] = f"SELECT {ROUGE_MEANS} FROM {rouge_rows(lambda c: sql_stems(ROUGE_TOK(c)))} x"
ORACLE["corpus_bleu"] = bleu_sql()
ORACLE["rouge_n"] = rouge_sql()
ORACLE["scale_round"] = (f"SELECT 'bleu' AS metric, bleu AS value FROM ({bleu_sql()}) b UNION ALL "
                         f"SELECT 'rouge1', rouge1 FROM ({rouge_sql()}) r UNION ALL "
                         f"SELECT 'rouge2', rouge2 FROM ({rouge_sql()}) r2")


@oracle("gen_len")
def _():
    return f"SELECT round_even(avg(len(input_ids)), 4) AS gen_len FROM {TOKD} t"


@oracle("count_examples")
def _():
    return ("SELECT CASE split WHEN 'train' THEN 'train_samples' WHEN 'validation' THEN 'eval_samples' ELSE "
            "'predict_samples' END AS metric, least(count(*), CASE split WHEN 'train' THEN 500 WHEN 'validation' "
            f"THEN 50 ELSE 1000 END) AS value FROM {C4} c GROUP BY split")


# ----------------------------------------------------------- sinks, files
ORACLE["write_corpus"] = ORACLE["wiki_large"]


@oracle("write_predictions")
def _():
    s = strip_sql("edited")
    return (f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS line, "
            f"replace(replace(replace({s}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r') AS value FROM {RELATED} r")


@oracle("pair_by_position")
def _():
    def line(c: str) -> str:
        return f"replace(replace(replace({strip_sql(c)}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r')"
    return (f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS line, {line('edited')} AS prediction, {line('text')} AS reference FROM {RELATED} r")


@oracle("write_metrics")
def _():
    return (f"SELECT b.bleu AS eval_bleu, r.rouge1 AS eval_rouge1, r.rouge2 AS eval_rouge2 FROM ({bleu_sql()}) b, "
            f"({rouge_sql()}) r")


ORACLE["stream_examples"] = f"SELECT * FROM ({ORACLE['wiki_large']}) w WHERE type <> 'no edit'"


@oracle("read_files")
def _():
    return (f"SELECT row_id, input, output, CASE WHEN CAST(split_part(row_id, ':', 1) AS INTEGER) % 2 = 0 "
            f"THEN 'train' ELSE 'validation' END AS split FROM {CONV} c")


@oracle("assign_prompts")
def _():
    sp = sample_prompts_rows(_src(CONV), CAT["formality"], 2, SEED, "j1")
    return f"SELECT row_id, string_agg(prompt, ' | ' ORDER BY j) AS prompts FROM {sp} t GROUP BY row_id"
