"""The queries in SQL, over whole tables, as plain statements of the problems that share nothing with the operators."""

from __future__ import annotations

_ODD = "\u00a0\u200b"


def _bare(x: str) -> str:
    """A brand as written by sellers, down to its letters, digits and single spaces."""
    x = f"regexp_replace(lower({x}), '[\u00ad\u2000-\u200f\u2060\ufeff\u2122\u00ae\u00a9]', '', 'g')"
    x = f"translate(strip_accents({x}), 'аеорсухіѕјкмнтвԁ@0341$5', 'aeopcyxisjkmhtbdaoealss')"
    x = f"regexp_replace(trim(regexp_replace({x}, '[^a-z0-9&().:-]+', ' ', 'g')), '^[^a-z0-9]+', '')"
    x = f"regexp_replace({x}, '^(linha|marca|fabricante|fab|by|brand)\\b[ .:]*', '')"
    after = "( -)?[ (-]+(loja oficial|oficial|tech br|tech|do brasil|brasil|inc|ltda|oem|bulk|br|original|sa)[).]*$"
    x = f"regexp_replace(regexp_replace({x}, '{after}', ''), '{after}', '')"
    return f"trim(regexp_replace({x}, '[^a-z0-9&]+', ' ', 'g'))"


def _edits(form: str) -> str:
    return f"CASE WHEN length({form}) >= 10 THEN 4 WHEN length({form}) >= 8 THEN 3 WHEN length({form}) >= 6 THEN 2 WHEN length({form}) >= 4 THEN 1 ELSE 0 END"


_BARE, _NAME, _SHORT = _bare("brand"), _bare("brandname"), _bare("shortname")
_MAPPED = rf"""
    WITH v AS (SELECT brand, {_BARE} AS bare FROM (SELECT DISTINCT brand FROM normalized_products WHERE regexp_replace(brand, '[\s{_ODD}]+', '', 'g') <> '')),
    r AS (SELECT brandid, {_NAME} AS bare, {_SHORT} AS short FROM brand_reference),
    f AS (SELECT *, replace(bare, ' ', '') AS f0, array_to_string(list_sort(string_split(bare, ' ')), '') AS f1 FROM v),
    g AS (SELECT *, replace(bare, ' ', '') AS g0, array_to_string(list_sort(string_split(bare, ' ')), '') AS g1 FROM r),
    x AS (SELECT brand, brandid, CASE WHEN f0 = replace(short, ' ', '') AND f0 <> '' THEN -1
                 WHEN f0 = '' THEN NULL
                 ELSE least(CASE WHEN levenshtein(f0, g0) <= {_edits("g0")} THEN levenshtein(f0, g0) END,
                            CASE WHEN levenshtein(f1, g1) <= {_edits("g1")} THEN levenshtein(f1, g1) END) END AS dist
          FROM f CROSS JOIN g),
    y AS (SELECT brand, brandid, dist, min(dist) OVER (PARTITION BY brand) AS least FROM x),
    m AS (SELECT brand, CASE WHEN count(*) = 1 THEN min(brandid) ELSE -1 END AS brandid FROM y WHERE dist = least GROUP BY brand)"""

#: Listings with an item: t6 (id, item).
_ITEMS = rf"""{_MAPPED},
    named AS (SELECT v.brand, v.bare, m.brandid FROM v LEFT JOIN m ON v.brand = m.brand),
    known AS (SELECT {_NAME} AS name, '#' || brandid AS b FROM brand_reference UNION SELECT bare, bare FROM named WHERE coalesce(brandid, -1) = -1 AND bare <> ''),
    t1 AS (SELECT n.id, x.bare, x.brandid, lower(strip_accents(translate(n.originaltitle, '×', 'x'))) AS t FROM normalized_products n LEFT JOIN named x ON n.brand = x.brand WHERE n.originaltitle IS NOT NULL),
    t2 AS (SELECT *, ' ' || regexp_replace(t, '[^a-z0-9&]+', ' ', 'g') || ' ' AS ws,
        CASE WHEN regexp_matches(t, '(^|[^a-z0-9])[a-z][a-z][ -]?[0-9]{{5}}([^0-9g]|$)') THEN regexp_extract(t, '(^|[^a-z0-9])([a-z][a-z][ -]?[0-9]{{5}})([^0-9g]|$)', 2)
             ELSE regexp_extract(t, '(^|[^a-z0-9])([a-z][a-z][0-9]{{3}})([^0-9]|$)', 2) END AS c FROM t1
        WHERE NOT regexp_matches(t, '(^|[^a-z])(suporte|case|cabo|adaptador|dissipador|parafuso|espacador|pelicula|capa)([^a-z]|$)')),
    t3 AS (SELECT *, regexp_replace(c, '[ -]', '') AS code, regexp_extract(substring(t, strpos(t, c) + length(c)), '^[ -]?(pro|plus|max|lite|neo)([^a-z]|$)', 1) AS suffix,
        coalesce(try_cast(nullif(regexp_extract(t, '(^|[^0-9])([0-9]{{1,2}}) ?x ?[0-9]+ ?gb?([^a-z]|$)', 2), '') AS INT), try_cast(nullif(regexp_extract(t, '[0-9] ?gb? ?x ?([0-9]{{1,2}})([^0-9a-z]|$)', 1), '') AS INT), try_cast(nullif(regexp_extract(t, 'kit [0-9]+ ?gb? ([0-9]+)x[0-9]+', 1), '') AS INT), 1) AS kit,
        coalesce(try_cast(nullif(regexp_extract(t, '(^|[^0-9])[0-9]{{1,2}} ?x ?([0-9]+) ?gb?([^a-z]|$)', 2), '') AS INT), try_cast(nullif(regexp_extract(t, '([0-9]+) ?gb? ?x ?[0-9]{{1,2}}([^0-9a-z]|$)', 1), '') AS INT)) AS module,
        list_max([replace(regexp_extract(y, '[0-9]+([.,][0-9]+)?'), ',', '.')::DOUBLE * CASE WHEN regexp_matches(y, '(tb|tera|t)[^a-z0-9/]?$') THEN 1000000 WHEN regexp_matches(y, 'mb[^a-z0-9/]?$') THEN 1 ELSE 1000 END
                  FOR y IN regexp_extract_all(t || ' ', '[0-9]+(?:[.,][0-9]+)? ?(?:tb|tera|gb|mb|g|t)[^a-z0-9/]')]) AS mb,
        (SELECT arg_min(k.b, (-length(k.name), strpos(ws, k.name))) FROM known k WHERE contains(ws, ' ' || k.name || ' ')) AS titled FROM t2 WHERE c <> ''),
    t4 AS (SELECT id, code, suffix, kit, round(greatest(mb, kit * coalesce(module, 0) * 1000)) AS size, CASE WHEN brandid > 0 THEN '#' || brandid ELSE coalesce(titled, nullif(bare, '')) END AS b FROM t3),
    t5 AS (SELECT *, min(b) OVER w AS lo, max(b) OVER w AS hi FROM t4 WINDOW w AS (PARTITION BY code, suffix, kit, size)),
    t6 AS (SELECT DISTINCT id, code || '|' || suffix || '|' || kit || '|' || coalesce(size::VARCHAR, '') || '|' || coalesce(b, CASE WHEN lo = hi THEN lo END, '?' || id) AS item FROM t5)"""

# What unfilled titles, filler and messages look like.
_LATIN = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud"
_RESIDUE = [
    r"\{\{|\{%|<%|\$\{|#\{|\[\[|@@[^@]+@@|\{[a-z_][a-z0-9_.]*\}|\{[0-9]+\}|(^|[^a-z0-9_])__[a-z0-9_.]+__([^a-z0-9_]|$)|(^|[^a-z0-9_%])%[a-z_][a-z0-9_.]*%([^a-z0-9_%]|$)|(^| )%[sd]( |$)|</?[a-z][^<>]*>|<!--|&lt;[a-z0-9_.]+&gt;|t\(''[a-z.]+''\)",
    r"translation missing|missing_translation|\[object object\]|function ?\(\)|#ref!|#n/d|\[inserir|todo: |xxx-xxx|(^| )000gb|(^|: |- |[|] )(nome do produto|descrição curta do item|produto sem título|sample product name)|insira o nome|título do produto aqui|product title goes here|digite aqui o título",
    r"(nan|null|undefined) ?gb|\(null\)|(^|[^a-z0-9])(undefined|null|nan) *($|[|/,;:()–-])|^none$|undefined (undefined|nan)",
    rf"lorem ipsum|(^|[^a-z])({_LATIN}) ({_LATIN}) ({_LATIN})([^a-z]|$)|blah blah|foo bar|asdf|qwerty|^a{{5,}}$|^x+( x+)+$|^z+ 1+$|teste teste|teste - ignorar|do not buy|nao comprar",
    r"(http|erro|error) [45][0-9][0-9]|[45][0-9][0-9] (- )?(not found|página não encontrada|forbidden|acesso negado|muitas requisições|serviço indisponível|internal server error|bad gateway|gateway time-?out|produto removido)",
    r"internal server error|bad gateway|gateway time-?out|serviço indisponível|página não encontrada|não encontramos essa página|página expirada|sessão expirou|acesso negado|access to this page|^forbidden|algo deu errado|something went wrong|falha ao carregar|conexão recusada|unexpected token|muitas requisições|produto removido|em manutenção|(^|: )(not found|forbidden) *($|[|(–-])|just a moment|só um momento|aguarde, carregando|carregando produto|checking your browser|verificando se você|não é um robô|security check",
    r"enable (javascript|js)|(ative o|precisa de) javascript|javascript is disabled|habilite cookies|habilitar scripts",
]

_KINDS = ("placeholder", "placeholder", "empty", "filler", "error", "error", "script")
_TITLES = r"""(SELECT id, trim(regexp_replace(lower(title), '[\s\x{00A0}\x{200B}]+', ' ', 'g')) AS t FROM raw_products)"""

#: Words of documents and items: norm (kind, id, field, w).
_NORM = r"""
    norm AS (
      SELECT kind, id, field, regexp_extract_all(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               text, '<!--|-->|</?[a-zA-Z][a-zA-Z0-9]*(\s+[a-zA-Z-]+(\s*=\s*("[^"]*"|''[^'']*''|[^\s<>]+))?)*\s*/?>', ' ', 'g'), '&(nbsp|#160);', ' ', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;|&#39;|&apos;', ' ', 'g'), '&amp;', '&', 'g'))),
               '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '[\p{L}\p{N}]+') AS w
      FROM (SELECT 'doc' AS kind, doc_id AS id, NULL AS field, text FROM documents UNION ALL SELECT 'item', item_id, 'prompt', prompt FROM eval_items UNION ALL SELECT 'item', item_id, 'answer', answer FROM eval_items) x
      WHERE text IS NOT NULL)"""

SQL: dict[str, str] = {
    "p6_kinds": f"""
    SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, CASE {" ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, k in zip(_RESIDUE, _KINDS, strict=True))} END AS kind FROM {_TITLES} x) y
    WHERE kind IS NOT NULL GROUP BY kind""",
    "p8_runs": f"""
    WITH {_NORM},
    gram AS (SELECT kind, id, field, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM norm WHERE len(w) >= 12) y),
    hit AS (SELECT d.id AS doc_id, t.id AS item_id, t.field, d.i, t.i - d.i AS shift FROM gram d JOIN gram t ON d.g = t.g WHERE d.kind = 'doc' AND t.kind = 'item'),
    island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, field, shift ORDER BY i) AS part FROM hit),
    run AS (SELECT doc_id, item_id, field, count(*) + 11 AS run FROM island GROUP BY doc_id, item_id, field, shift, part)
    SELECT doc_id, item_id, field, max(run)::INT AS run FROM run GROUP BY ALL""",
    "p2_found": rf"""{_ITEMS}
    SELECT x.id AS id_a, y.id AS id_b FROM t6 x JOIN t6 y ON x.item = y.item AND x.id < y.id""",
    "p2_groups": rf"""{_ITEMS}
    SELECT id, min(id) OVER (PARTITION BY item) AS groupid, count(*) OVER (PARTITION BY item) AS members FROM t6""",
    "p6_found": r"""
    SELECT DISTINCT id FROM (SELECT id, trim(regexp_replace(lower(title), '[\s\x{00A0}\x{200B}]+', ' ', 'g')) AS t FROM raw_products) x
    WHERE """ + " OR ".join(f"regexp_matches(t, '{p}')" for p in _RESIDUE),
    "p8_found": f"""
    WITH {_NORM},
    gram AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 10)) AS i FROM norm WHERE len(w) >= 12) y)
    SELECT DISTINCT d.id AS doc_id, t.id AS item_id FROM gram d JOIN gram t ON d.g = t.g WHERE d.kind = 'doc' AND t.kind = 'item'""",
    "p5_found": """
    WITH u AS (SELECT DISTINCT id, provider, providerproductid AS pid,
                 lower(trim(CASE WHEN regexp_matches(url, '[?&]to=') THEN url_decode(regexp_extract(url, '[?&]to=([^&#\\s]+)', 1)) ELSE url END)) AS a FROM raw_products),
    n AS (SELECT id, provider, nullif(ltrim(regexp_replace(pid, '[^0-9]', '', 'g'), '0'), '') AS x,
                 nullif(ltrim(coalesce(nullif(regexp_extract(a, '[?&]id=([0-9]{7,})', 1), ''),
                                       regexp_extract(regexp_replace(a, '[?#].*$', ''), '[/-]p?([0-9]{7,})([^a-z0-9]|$)', 1)), '0'), '') AS y FROM u),
    k AS (SELECT id, provider, x AS num FROM n WHERE x IS NOT NULL UNION SELECT id, provider, y FROM n WHERE y IS NOT NULL),
    f AS (SELECT provider, num, min(id) AS first FROM k GROUP BY ALL)
    SELECT DISTINCT k.id FROM k JOIN f ON k.provider = f.provider AND k.num = f.num WHERE f.first < k.id""",
    "p3_found": f"""{_MAPPED}
    SELECT n.id, coalesce(m.brandid, -1)::INT AS brandid
    FROM normalized_products n JOIN v ON n.brand = v.brand LEFT JOIN m ON n.brand = m.brand
    WHERE n.brand NOT IN (SELECT brandname FROM brand_reference)""",
    "p3_unmatched": f"""{_MAPPED}
    SELECT n.brand AS value, count(*) AS n FROM normalized_products n JOIN v ON n.brand = v.brand LEFT JOIN m ON n.brand = m.brand
    WHERE coalesce(m.brandid, -1) = -1 GROUP BY n.brand""",
    "p7_found": """
    WITH RECURSIVE e AS (
      SELECT leftid AS a, rightid AS b FROM comparisons
      WHERE leftid IS NOT NULL AND rightid IS NOT NULL AND leftid <> rightid
        AND regexp_replace(trim(upper(verdict)), '[^A-Z]+', '_', 'g') IN ('IDENTICAL', 'LIKELY_IDENTICAL')),
    n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a AS id, a AS r FROM n UNION SELECT reach.id, n.b FROM reach JOIN n ON reach.r = n.a)
    SELECT id, min(r) AS groupid FROM reach GROUP BY id""",
}
