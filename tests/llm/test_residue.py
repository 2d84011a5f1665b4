from __future__ import annotations

from re import _constants as op
from re import _parser

from pyspark.sql import functions as F

from garimpo.llm import residue

RESIDUE = {
    "placeholder": ["{{ title }}", "SSD {brand} 1TB", "${item?.name ?? ''}", "RAM <%= sku %> 8GB", "{% for p in x %}", "#{nome}", "[[marca]]", "@@sku@@ SSD", "__NOME__", "%title%", "Drive %s", "<h2></h2>", "&lt;title&gt;", "[object Object]", "translation missing: pt.x", "#REF!", "Nome do produto (código 1)", "TODO: preencher título", "xxx-xxx 000GB", "Disco {0}", "t('product.title')"],
    "empty": ["undefined", "SSD undefined NaNGB", "null - nullGB", "(null)", "None", "SSD Vortaq | null", "GPU NaN GB"],
    "filler": ["lorem ipsum dolor", "SSD tempor incididunt ut labore", "blah blah blah", "foo bar baz", "asdf asdf", "aaaaaaa", "TESTE - IGNORAR", "test item do not buy", "zzzz 1111"],
    "error": ["Erro 404: Página não encontrada", "HTTP 503 Serviço indisponível", "Error 502 (código 1)", "Acesso negado (403)", "Estamos em manutenção", "Aguarde, carregando...", "Só um momento...", "Just a moment…", "Confirme que não é um robô", "Unexpected token < in JSON", "Drive: 404 - Not Found", "Not Found | loja BR", "Unidade: Forbidden", "Site em manutenção, volte mais tarde (ref. 1a2b)"],
    "script": ["Please enable JavaScript to view this page", "Ative o JavaScript para continuar", "JavaScript is disabled in your browser", "Habilite cookies e JavaScript", "Você precisa habilitar scripts no navegador"],
}
REAL = [
    "SSD Vortaq Apex AB12345 1TB 100% novo {Kit completo} [Lacrado]", "Camiseta Undefined Behavior + SSD Vortaq 1TB", "Caneca Null Pointer e HD 4TB", "Livro Erro Humano brinde SSD 480 GB", "Adesivo Not Found 404 para Gabinete - SSD 1TB",
    "Mousepad JavaScript Dev + RAM 2x8GB", "Placa Teste POST Diagnóstico c/ SSD 1TB", "Cadeado p/ Acesso Restrito com SSD 1TB", "Nome Gravado no Produto: SSD 1TB 6Gb/s", "[Novo] {Kit 2 peças} SSD 1TB", "100% Original % OFF SSD 1TB", "Memória Nanomax 8GB", "", None, "   ",
]


def test_kinds_and_real_titles(spark, rows):
    data = [(f"{k}{i}", "h", t) for k, ts in RESIDUE.items() for i, t in enumerate(ts)] + [(f"real{i}", "h", t) for i, t in enumerate(REAL)]
    df = spark.createDataFrame(data, "id string, host string, title string").withColumns({"text": F.lit("{{x}}"), "kind": F.lit("k"), "key": F.lit("k")})
    got = dict(rows(residue.residue(df, "host", "title")))
    assert {i for i in got if i.startswith("real")} == set()
    assert {i for i, _, _ in data if not i.startswith("real")} - set(got) == set()
    assert [(i, k) for i, k in got.items() if not i.startswith(k) and not i.startswith(("empty", "filler"))] == []


def test_recurrent_phrases_are_subtracted(spark, rows):
    """A phrase with a message in it that recurs beside real content is boilerplate; the message by itself is not."""
    data = [(f"b{i}", "h", f"Adesivo Erro 404 para Gabinete - SSD Vortaq AB{i:05d} {i + 1}TB novo") for i in range(6)] + [("e", "h", "Erro 404"), ("n", None, "null")]
    df = spark.createDataFrame(data, "id string, host string, title string")
    assert rows(residue.residue(df, "host", "title")) == [("e", "error"), ("n", "empty")]


def test_recurrent_messages_stay(spark, rows):
    """Messages with a reference mark are many different texts; none of their parts may be subtracted."""
    data = [(f"{k}{i}", "h", f"{t} - ref. {i:04x}aa") for k, t in (("a", "Digite aqui o título do anúncio"), ("b", "Site em manutenção, volte mais tarde"), ("c", "404 Página não encontrada | loja")) for i in range(12)]
    df = spark.createDataFrame(data, "id string, host string, title string")
    assert residue.residue(df, "host", "title").count() == 36


def test_empty_repeats_and_long_texts(spark, rows):
    df = spark.createDataFrame([("1", "h", "{{x}}"), ("1", "h", "{{x}}"), ("2", "h", "palavra " * 40_000 + "{{x}}")], "id string, host string, title string")
    assert rows(residue.residue(df, "host", "title"), "id") == [("1",), ("2",)]
    assert residue.residue(df.limit(0), "host", "title").count() == 0


def wildcards(parsed):
    """Parts of a parsed pattern that match MARK."""
    for kind, arg in parsed:
        if kind is op.ANY or (kind is op.NOT_LITERAL and arg != ord(residue.MARK)):
            yield kind
        elif kind is op.IN and arg[0][0] is op.NEGATE and not {(op.LITERAL, ord(residue.MARK)), (op.CATEGORY, op.CATEGORY_SPACE)} & set(arg):
            yield arg
        elif kind is op.IN and (op.CATEGORY, op.CATEGORY_NOT_WORD) in arg:
            yield arg
        elif kind is op.BRANCH:
            for branch in arg[1]:
                yield from wildcards(branch)
        elif kind is op.SUBPATTERN:
            yield from wildcards(arg[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            yield from wildcards(arg[2])


def test_no_pattern_reaches_over_a_mark():
    """So evidence in a residual is evidence in the text, and only texts with evidence need their residual."""
    for pattern in residue.KINDS.values():
        assert list(wildcards(_parser.parse(pattern.replace(r"[\p{L}_$]", "[a_$]").replace(r"[\p{L}\w.$-]", "[a1.]").replace(r"\p{L}", "[ab]")))) == []


def test_lines_are_counted_over_all_texts(spark, rows):
    """Lines without any message are counted and subtracted as well; separators and the rest stay in place."""
    data = [(f"{i}", "h", f"Pronta entrega | SSD Vortaq AB{i:05d} interno {i + 1}TB novo") for i in range(4)] + [("x", "h", "Pronta entrega\r\n {{nome}} | HD 1TB")]
    df = spark.createDataFrame(data, "id string, host string, text string").select("host", residue.normal(F.col("text")).alias("text"))
    found = rows(residue.boilerplate(df))
    assert ("h", "pronta entrega") in found and ("h", "{{nome}}") not in found
    got = df.select(residue.subtracted(F.col("text"), F.array(F.lit("pronta entrega"))).alias("rest")).filter(F.col("text").contains("nome"))
    assert rows(got) == [(f"{residue.MARK} | {{{{nome}}}} | hd 1tb",)]


def test_short_evidence_is_found(spark, rows):
    data = ["Ative o JS para continuar", "Habilite JS", "This site requires JS", "Insira o nome", "Digite aqui o nome", "Preencha o nome", "Gone", "xx yy zz", "exercitation ullamco laboris", "sed ut enim", "Too many requests"]
    df = spark.createDataFrame([(f"{i:02d}", "h", t) for i, t in enumerate(data)], "id string, host string, title string")
    assert rows(residue.residue(df, "host", "title"), "id") == [(f"{i:02d}",) for i in range(len(data))]
