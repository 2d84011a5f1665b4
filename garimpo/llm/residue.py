"""Template residue, filler and error-page text in place of content.

1. Equal texts of a host are handled once. Every text is cut into lines: at line breaks and separators, and the first
   three to five words as a line of their own. Lines are normalised and counted by host, over all different texts.
2. A line is boilerplate if it recurs, if most texts that have it hold real content beside it, and if it is no evidence of
   its own: an error or script message only is boilerplate between words of a longer phrase ("Adesivo Erro 404 para
   Gabinete"), placeholders, printed empty values and filler never are.
3. Boilerplate is subtracted: MARK, which no part of a pattern matches and which is no end of a text, takes its place.
4. What is left is searched for evidence of unfilled placeholders, printed empty values, filler, error pages and notices
   that scripts are needed.

Lines are cut at white space or separators, and no match reaches over a MARK, so whatever is evidence in the residual is
evidence in the text as well. Hence step 3 is carried out for texts with evidence only; the others could not gain any.
The distances in the patterns ("within 20 characters") are part of what counts as evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import let
from garimpo.functions.text import single_spaced
from garimpo.operators.skew import HOT_ROWS, HOT_SHARE, lookup
from garimpo.session import cut

# Patterns of evidence, by kind. Texts are matched in lower case, with odd spaces made plain. No part of a
# pattern matches MARK ("▮").
_NAME = r"[\p{L}_$][\p{L}\w.$-]*"
PLACEHOLDER = "|".join([
    r"\{\{[^{}▮]*\}\}|\{\{|\{%[^▮]*?%\}|<%[^▮]*?%>|\$\{[^{}▮]*\}|#\{[^{}▮]*\}|\[\[[^\[\]▮]*\]\]|@@[^@▮]+@@",
    rf"\{{(?:{_NAME}|\d+)\}}|(?<!\w)__{_NAME}?__(?!\w)|(?<![\w%])%(?:{_NAME})%(?!\w)|(?<!\S)%[sd](?!\S)",
    r"</?[a-z][a-z0-9]*(?: [^<>▮]*)?/?>|<!--|&lt;/?[\w.]+&gt;|\bt\('[\w.]+'\)",
    r"translation missing|missing_translation|\bi18n\.|\[object object\]|function ?\(\) ?\{|#ref!|#n/[da]\b|#valu?or?!|#value!",
    r"\[(?:inserir|insira|insert|nome|titulo|título|title|modelo|marca)[^\]▮]*\]|\btodo: |xxx-xxx|\b000gb\b",
    r"(?:^|[|:–-] ?)(?:nome do produto|t[íi]tulo do produto|descri[cç][aã]o (?:curta )?do (?:item|produto)|produto sem (?:t[íi]tulo|nome)|product (?:title|name)|sample product(?: name)?|untitled product)(?= *(?:$|[|(:–-]|aqui|goes here))",
    r"\b(?:insira|digite|coloque|preencha)(?: aqui)? o (?:nome|t[íi]tulo)\b|t[íi]tulo do produto aqui|product title goes here|sample product name|preencher t[íi]tulo",
])
EMPTY = "|".join([
    r"\bnan ?[gtm]b\b|\bnull ?[gtm]b\b|\bundefined ?[gtm]b\b|\(null\)|\b(?:undefined|null|nan)\b(?= *(?:$|[|/,;:()–-]))",
    r"^(?:none|nan|nil|null|undefined)$|\bundefined undefined\b|\bundefined nan|^(?:none|nil) *[|(–-]",
])
_LATIN = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris"
FILLER = "|".join([
    rf"lorem ipsum|\b(?:{_LATIN}) (?:{_LATIN}) (?:{_LATIN})\b",
    r"\bblah blah\b|\bfoo bar\b|\basdf\b|\bqwerty\b|^(\p{L})\1{4,}+$|^(?:(\p{L})\2++ ?+)++(?:(\d)\3++)?$",
    r"\bteste?s? ?[-–:]? ?(?:teste|ignorar|ignore|123)\b|\b(?:test|teste)\b[^▮]*\b(?:do not buy|n[aã]o comprar)|\bdo not buy\b|\bn[aã]o comprar\b",
])
_MESSAGE = r"not found|p[áa]gina n[ãa]o encontrada|forbidden|acesso negado|muitas requisi[çc][õo]es|too many requests|servi[çc]o indispon[íi]vel|service unavailable|internal server error|bad gateway|gateway time-?out|produto removido|unauthorized|n[ãa]o autorizado|gone"
ERROR = "|".join([
    rf"\b(?:http|erro|error)[^\w▮]{{0,2}}[45]\d\d\b|\b[45]\d\d[^\w▮]{{0,3}}(?:{_MESSAGE})|(?:{_MESSAGE}) ?\([45]\d\d\)|(?:^|: )(?:{_MESSAGE})(?= *(?:$|[|(–-]))",
    r"internal server error|bad gateway|gateway time-?out|service unavailable|servi[çc]o indispon[íi]vel|p[áa]gina n[ãa]o encontrada|n[ãa]o encontramos (?:essa|esta|a) p[áa]gina|page not found",
    r"p[áa]gina expirada|sess[ãa]o expirou|session (?:has )?expired|acesso negado|access denied|access to this page|^forbidden\b|algo deu errado|something went wrong|falha ao carregar|failed to load",
    r"conex[ãa]o recusada|connection refused|unexpected token|muitas requisi[çc][õo]es|too many requests|produto removido|em manuten[çc][ãa]o|under maintenance|volte mais tarde",
    r"just a moment|s[óo] um momento|\baguarde\b[^▮]{0,3}carregando|^(?:\w+: ?)?(?:aguarde|carregando|loading)\b|\bcarregando (?:produto|p[áa]gina|\.\.\.)|checking your browser|verificando se voc[êe]|n[ãa]o [ée] um rob[ôo]|are you a robot|security check|attention required|captcha",
])
SCRIPT = r"\b(?:enable|habilite|habilitar|ative|ativar|precisa de|requires?|necess[áa]rio) [^▮]{0,20}(?:javascript|\bjs\b|scripts?\b|cookies)|javascript (?:is |est[áa] )?(?:disabled|required|desativado|desabilitado|necess[áa]rio)"

KINDS = {"placeholder": PLACEHOLDER, "empty": EMPTY, "filler": FILLER, "error": ERROR, "script": SCRIPT}

#: A line recurs if at least this many different texts of a host have it, and is boilerplate only where at least CONTENT of them hold content beside it.
RECURS = 3
CONTENT = 0.8
#: Content beside a line: this many words, one of them with a digit, apart from reference marks.
CONTENT_WORDS = 5
MARKS = r"\(?\b(?:ref\.?|c[óo]digo|code|protocolo)[ :#]*\w+\)?"
#: What takes the place of boilerplate.
MARK = "\u25ae"


def normal(text: Column) -> Column:
    """Lower case with plain single spaces and line breaks as separators, without an ellipsis sign or invisible characters."""
    broken = F.regexp_replace(F.lower(text), r"[\r\n\u2028\u2029]+", " | ")
    return F.regexp_replace(single_spaced(F.translate(broken, MARK, " ")), "\u2026", "...")


def kind_of(text: Column) -> Column:
    """The first kind of evidence in a normalised text, null if there is none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(list(KINDS.items())):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(kind)).otherwise(out)
    return out


#: Separators between lines.
SEPARATORS = r" [|/+–-] |, |: "


def _openings(text: Column) -> list[Column]:
    """The first three, four and five words of a text with more of them, else null."""
    return [F.when(x != text, x) for x in (F.substring_index(text, " ", n) for n in (3, 4, 5))]


def lines(text: Column) -> Column:
    """Lines of a normalised text: what separators and breaks leave, and its first three, four and five words."""
    return F.array_distinct(F.concat(F.array_compact(F.array(*_openings(text))), F.transform(F.split(text, SEPARATORS), F.trim)))


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def boilerplate(texts: DataFrame) -> DataFrame:
    """(host, line): recurrent lines of different `texts` (host, text) that have content beside them and are no evidence of their own.

    All lines of all texts are counted. Content beside a line: its text has CONTENT_WORDS more words, and a digit more.
    """
    bare = F.regexp_replace("text", MARKS, " ")
    words = F.regexp_count(bare, F.lit(r"[\p{L}\p{N}][^ ]*"))
    df = texts.select("host", words.alias("words"), _digits(bare).alias("digits"), lines(F.col("text")).alias("lines"))
    df = df.select("host", "words", "digits", F.explode("lines").alias("line")).filter(F.col("line") != "")
    own_words = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    beside = (F.col("words") - own_words >= CONTENT_WORDS) & (F.col("digits") > _digits(F.col("line")))
    counted = df.groupBy("host", "line").agg(F.count("*").alias("n"), F.count_if(beside).alias("with_content"))
    recurrent = (F.col("n") >= RECURS) & (F.col("with_content") >= CONTENT * F.col("n"))
    # Words on both sides, near enough that the search stays linear in long lines.
    inside = rf"\p{{L}}{{3,}} .{{0,60}}?(?:{ERROR}|{SCRIPT}).{{0,60}}? \p{{L}}{{3,}}"
    harmless = lambda kind: kind.isNull() | (kind.isin("error", "script") & F.regexp_like("line", F.lit(inside)))
    # One condition: by itself the search would be pushed below the counting, to all lines.
    return counted.filter(F.when(recurrent, let(kind_of(F.col("line")), harmless)).otherwise(False)).select("host", "line")


def subtracted(text: Column, gone: Column) -> Column:
    """A normalised text with each of its lines that is in `gone` (array) replaced by MARK."""
    opening = F.coalesce(*[F.when(F.array_contains(gone, x), F.length(x)) for x in reversed(_openings(text))], F.lit(0))
    rest = let(opening, lambda n: F.when(n > 0, F.concat(F.lit(MARK), F.substring(text, n + 1, F.length(text)))).otherwise(text))
    # The pieces, each with the separator that ends it.
    pieces = F.regexp_extract_all(rest, F.lit(f".+?(?:{SEPARATORS}|$)"), F.lit(0))
    core = lambda p: F.trim(F.regexp_replace(p, f"(?:{SEPARATORS})$", ""))
    ends = lambda p: F.regexp_extract(p, f"(?:{SEPARATORS})$", 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(F.array_contains(gone, core(p)), F.concat(F.lit(MARK), ends(p))).otherwise(p)), "")


def residue(records: DataFrame, host: str, text: str, id_column: str = "id") -> DataFrame:
    """(id, kind): the records whose text is or contains residue, once for each id.

    Null and blank texts are no residue. Texts of any length are read whole. A null host counts as a host of its own.
    """
    t = records.select(F.col(id_column).alias("id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("raw")).filter(F.col("raw").isNotNull())
    key = F.concat("host", F.lit("\x1f"), "raw")
    # Written once: lines are counted over all of them, then evidence is searched in each.
    raws = cut(t.groupBy("host", "raw").agg(F.count("*").alias("n")).select("host", "raw", "n", normal(F.col("raw")).alias("text")))
    evident = cut(raws.filter((F.col("text") != "") & kind_of(F.col("text")).isNotNull()))
    own = evident.select("host", "text", F.explode(lines(F.col("text"))).alias("line")).distinct()
    common = boilerplate(raws.filter(F.col("text") != "").select("host", "text").distinct())
    hits = own.filter(F.col("line") != "").join(common, ["host", "line"]).groupBy("host", "text").agg(F.collect_set("line").alias("gone"))
    left = let(F.when(F.col("gone").isNull(), F.col("text")).otherwise(subtracted(F.col("text"), F.col("gone"))), kind_of)
    judged = cut(evident.join(hits, ["host", "text"], "left").select(key.alias("key"), left.alias("kind"), "n")).filter(F.col("kind").isNotNull())
    # A text with very many records is hot; at most HOT_SHARE texts are.
    total = raws.agg(F.sum("n")).first()[0] or 0
    hot = judged.filter(F.col("n") >= max(HOT_ROWS, total // HOT_SHARE)).select("key", "n").collect()
    return lookup(t.select("id", key.alias("key")), "key", judged, "kind", hot).filter(F.col("kind").isNotNull()).select("id", "kind").distinct()
