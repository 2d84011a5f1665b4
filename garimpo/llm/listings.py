"""Listings of the same item under different titles: voting over token combinations.

1. Titles are cut into tokens; those that can identify an item are kept with their position: model codes (letters and
   digits, however joined), a variant suffix that stands by a code, the capacity, the modules of a kit, and the brand. In a
   title without any code they are the words that belong to a brand: words most of whose titles are of one brand.
2. Titles with the same tokens form one profile with a weight, so copies of one listing are handled once.
3. Every combination of a model code with one or more other tokens of its profile is a candidate, and the bare code of a
   profile that has no other token. Its score is
   (length in characters) x ln(1 + titles that have it) / (1 + its average position): frequent, long and early wins.
   Each profile votes for its best combination; the titles that vote for one are a cluster, and the code in it is their model.
4. Verification splits what shares a combination but not brand, model with suffix, capacity and modules; clusters of
   different combinations that agree in all of these are merged. A title that names no brand joins the only brand known
   for the same model, suffix, capacity and modules; if there are several, it stays apart.

Accessories (a mount, case, cable ... for an item) are recognised by their own noun or by the item standing after "for",
and form no cluster with the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.llm.canonical_values import ACCENTED, BROADCAST_NAMES, LOOKALIKE, bare_sql, map_values
from garimpo.operators import units
from garimpo.operators.skew import hot_keys, lookup
from garimpo.session import cut

# Nouns of accessories, words that name a kind of item, and words that join the two.
ACCESSORIES = "suporte|case|cabo|adaptador|dissipador|parafuso|espacador|pelicula|capa|gaveta|bolsa|estojo|mount|bracket|cable|enclosure|heatsink|cooler|dock|etiqueta|adesivo"
KINDS = "ssd|hd|hdd|disco|hard|drive|solid|unidade|armazenamento|pendrive|pen|flash|memoria|mem|memory|ram|pente|placa|gpu|vga|graphics"
FOR = r"para|p/|compativel com|for|compatible with"
# Units after which a number measures something and is no part of a code.
MEASURES = r"-?(?:bits?|mhz|ghz|rpm|mt|mb|gb|tb|kb|gbps|mbps|w|v|pol|x|anos|g|t|tera|gigas?)\b|%|[.,]\d"

#: Largest group that one task pairs up by itself; larger ones are split into salts of this size.
PAIR_BLOCK = 1000


def folded(title: Column) -> Column:
    """Lower case without accents and look-alike letters, odd spaces made plain; null stays null."""
    x = units.plain(title)
    for old, new in (ACCENTED, LOOKALIKE):
        x = F.translate(x, old, new)
    return F.regexp_replace(x, "[\u200b\u0300-\u036f]", "")


# Variant words that are known whatever the titles, and words before a number that are no part of a code.
SUFFIXES = ("pro", "plus", "max", "lite", "neo")
NO_PREFIX = rf"{KINDS}|{'|'.join(SUFFIXES)}|evo|qvo|blue|black|green|red|gold|com|por|ate|nova|novo"
CODE = rf"(?<![a-z0-9])(?:(?<!\d )(?:gb|tb|mb|kb|mt)|(?!(?:gb|tb|mb|kb|mt)[ _-]?\d)(?!(?:{NO_PREFIX})[ _-]\d{{3,4}}(?!\d))[a-z]{{2,4}})[ _-]?\d{{3,6}}(?!\d)(?! ?(?:{MEASURES}))"
# Tokens with digits that name an interface, a generation or a form.
NO_MODEL = r"m2|22[3468][02]|22110|gen\d\w*|l?p?g?ddr\d\w*|cl\d+|usb\d*|pcie?\d*|sata\d*|nvme\d*|x\d+|kit\d*|rev\d+|20[12]\d"
#: Other codes, looked for where there is none of the first form: mixed letters and digits (a400, nv3, sn850x), or a bare number (990).
_BODY = rf"[a-z]{{1,8}}\d{{1,5}}(?:[a-z]{{1,3}}\d{{1,4}}|[a-z](?![a-z]))?|\d{{3,5}}(?:[a-z]{{1,2}}(?![a-z]))?"
MIXED = rf"(?<![a-z0-9.,/-])(?!(?:{NO_MODEL})(?![a-z0-9]))(?!\d+(?:[.,]\d+)? ?(?:{MEASURES}|[kmgt]ib\b))(?:{_BODY})(?:{'|'.join(SUFFIXES)})?(?![a-z0-9]|[.,]\d)(?! ?(?:{MEASURES}))"
#: A further word after a code, the start of a next code that is no such word, and words that are no variant of one code either.
WORD = r"[a-z]{2,12}"
ANY_CODE = rf"[a-z]{{2,4}}[ _-]\d{{3,6}}(?!\d)(?! ?(?:{MEASURES}))"
NO_SUFFIXES = rf"{KINDS}|{ACCESSORIES}|bits?|[mg]hz|rpm|mt|[mgtk]b|gbps|mbps|pol|anos|tera|gigas?|kit|nvme|sata|pcie|usb|gen|ddr"
#: A word is a variant of whatever code it follows if at least this share of the titles that have it show it right after one.
VARIANT_SHARE = 0.8
#: A word belongs to a brand if at least this share of its titles with a known brand are of that one.
BRAND_SHARE = 0.8


def _modules(t: Column) -> Column:
    """Number of modules of a kit; 1 if the title shows none."""
    shapes = [r"\b(\d{1,2}) ?x ?\d+ ?gb?\b", r"\d ?gb? ?x ?(\d{1,2})\b", r"kit \d+ ?gb? (\d{1,2})x\d+\b", r"\b(\d{1,2}) (?:pentes|modulos) de"]
    return F.coalesce(*[F.regexp_extract(t, s, 1).try_cast("int") for s in shapes], F.lit(1))


def _size(t: Column) -> Column:
    """Bytes of the item: the largest printed capacity, or modules times their size."""
    one = F.regexp_extract(t, r"\b\d{1,2} ?x ?(\d+) ?gb?\b", 1).try_cast("double")
    other = F.regexp_extract(t, r"(\d+) ?gb? ?x ?\d{1,2}\b", 1).try_cast("double")
    kit = _modules(t) * F.coalesce(one, other) * 1e9
    return F.floor(F.greatest(F.array_max(units.printed_capacities(t)), kit) + 0.5).cast("long")


def _codes(text: Column, pattern: str, body: str) -> Column:
    """array<struct<code, suffix, word, glued, raw>> of a folded text: `suffix` is a known variant after the code, `word` any other word there."""
    known = "|".join(SUFFIXES)
    found = F.regexp_extract_all(text, F.lit(rf"((?:{pattern})(?:[ _-]?(?:(?:{known})|(?!{ANY_CODE}){WORD})(?![a-z0-9]))?)"), F.lit(1))
    after = rf"^(?:{body})[ _-]?"
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_replace(F.regexp_extract(x, f"^({body})", 1), r"[ _-]", "").alias("code"),
            F.regexp_extract(x, rf"{after}({known})$", 1).alias("suffix"),
            F.regexp_extract(x, rf"{after}(?!(?:{known}|{NO_SUFFIXES})$)([a-z]{{2,}})$", 1).alias("word"),
            F.regexp_like(x, F.lit(r"[0-9]-?[a-z]+$")).alias("glued"),
            x.alias("raw"),
        ),
    )


def _none(text: Column) -> Column:
    return F.coalesce(text, F.array())


def named_in_title(base: DataFrame, known: DataFrame) -> DataFrame:
    """(id, titled): the longest known name in each title of base (id, t), the first of these. `known` is (run, brand), unique in run.

    Words are looked up in runs of as many words as known names have.
    """
    lengths = sorted(r[0] for r in known.select(F.size(F.split("run", " "))).distinct().collect())  # numbers of words, a few
    words = F.split(F.trim(F.regexp_replace("t", r"[^a-z0-9&]+", " ")), " ")
    run = lambda n: lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("run"), i.alias("pos"))
    runs = F.concat(*[F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), run(n))).otherwise(F.array()) for n in lengths or [1]])
    searched = base.withColumn("w", words).select("id", F.explode(runs).alias("r")).select("id", "r.run", "r.pos")
    if known.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        found = searched.join(F.broadcast(known), "run")
    else:
        found = lookup(searched, "run", known, "brand", hot_keys(searched, "run")).filter(F.col("brand").isNotNull())
    return found.groupBy("id").agg(F.min(F.struct(-F.length("run"), "pos", "brand")).alias("b")).select("id", F.col("b.brand").alias("titled"))


def tokens(listings: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, models, brand, size, kit, accessory) of listings (id, title, brand, model).

    `models` holds (code, suffix, pos) of every code in the title, else of the one in the model column, else the one entry
    of `_word_models`. `reference` is (id, name, short) of known brands; brands that are not listed are known by their
    spelling without case and accents. The word after a code is its suffix if it is one of SUFFIXES, if nearly all titles that
    have it show it right after a code (VARIANT_SHARE), or if it is written right after just this code in some title, or
    follows it in some model column. A brand typed freely is read first; where it means no listed brand the title is
    searched for a known one.
    """
    typed = listings.select(F.col("brand").alias("value"))
    mapped = map_values(typed, reference)
    bare = F.expr(bare_sql("value"))
    mapped = cut(mapped.select("value", F.when(F.col("id") >= 0, F.concat(F.lit("#"), F.col("id"))).alias("known"), F.when(F.col("id") < 0, bare).alias("own")))
    base = listings.select("id", folded(F.col("title")).alias("t"), folded(F.col("model")).alias("m"), F.col("brand").alias("value"))
    value_of = mapped.select("value", F.struct("known", "own").alias("named"))
    base = lookup(base, "value", value_of, "named", hot_keys(base, "value")).select("id", "t", "m", F.col("named.known").alias("known"), F.col("named.own").alias("own"))
    code, mixed = (CODE, r"[a-z]+[ _-]?[0-9]+"), (MIXED, _BODY)
    every = [_none(_codes(F.col(c), *form)) for form in (code, mixed) for c in ("t", "m")]
    base = cut(base.withColumns(dict(zip(("codes", "typed", "mixed", "typed_mixed"), every, strict=True))))
    names = reference.select(F.expr(bare_sql("name")).alias("run"), F.concat(F.lit("#"), F.col("id")).alias("brand"))
    others = mapped.filter(F.coalesce("own", F.lit("")) != "").select(F.col("own").alias("run"), F.col("own").alias("brand"))
    known = names.unionByName(others).filter(F.col("run") != "").groupBy("run").agg(F.min("brand").alias("brand"))
    in_title = named_in_title(base.filter(F.col("known").isNull()).select("id", "t"), known)
    pair = lambda c: F.concat_ws(" ", c["code"], c["word"])
    with_word = lambda cs: F.filter(cs, lambda c: c["word"] != "")
    pairs_of = lambda cs: F.transform(with_word(cs), pair)
    first = lambda *options: F.coalesce(*[F.when(F.size(x) > 0, F.col(x)) for x in options], F.array())
    in_text, in_model = first("codes", "mixed"), first("typed", "typed_mixed")
    own = base.select(F.explode(F.concat(pairs_of(F.filter(in_text, lambda c: c["glued"])), pairs_of(in_model))).alias("pair")).distinct()
    after = F.array_distinct(F.transform(with_word(in_text), lambda c: c["word"]))
    shown = base.select(after.alias("after"), F.explode(F.array_distinct(F.split("t", r"[^a-z]+"))).alias("word"))
    counts = shown.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.array_contains("after", F.col("word"))).alias("k"))
    variants = counts.filter((F.col("word") != "") & (F.col("k") >= VARIANT_SHARE * F.col("n"))).select("word", F.lit(True).alias("is_variant"))
    df = base.withColumn("codes", F.coalesce(*[F.when(F.size(x) > 0, F.col(x)) for x in ("codes", "typed", "mixed", "typed_mixed")], F.array())).drop("typed", "mixed", "typed_mixed")
    asked = df.select("id", F.explode(with_word(F.col("codes"))).alias("c")).select("id", F.col("c.word").alias("word"), pair(F.col("c")).alias("pair"))
    asked = lookup(asked, "word", variants, "is_variant", hot_keys(asked, "word"))
    asked = lookup(asked, "pair", own.withColumn("is_own", F.lit(True)), "is_own", hot_keys(asked, "pair"))
    confirmed = asked.filter(F.coalesce("is_variant", "is_own")).groupBy("id").agg(F.collect_set("pair").alias("confirmed"))
    df = df.join(in_title, "id", "left").join(confirmed, "id", "left")
    is_own = lambda c: (c["word"] != "") & F.coalesce(F.array_contains("confirmed", pair(c)), F.lit(False))
    place = lambda c: F.coalesce(F.size(F.split(F.call_function("substring_index", "t", c["raw"], F.lit(1)), r"[^a-z0-9]+")), F.lit(1))
    models = F.transform("codes", lambda c: F.struct(c["code"].alias("code"), F.when(is_own(c), c["word"]).otherwise(c["suffix"]).alias("suffix"), place(c).alias("pos")))
    accessory = F.col("t").rlike(rf"^(?:[^|/,]*?\b)?(?:{ACCESSORIES})\b.*\b(?:{KINDS})\b") | F.col("t").rlike(rf"(?:^|\s)(?:{FOR}) (?:{KINDS})\b")
    brand = F.coalesce("known", "titled", F.when(F.col("own") != "", F.col("own")))
    out = cut(df.select("id", "t", models.alias("models"), brand.alias("brand"), _size(F.col("t")).alias("size"), _modules(F.col("t")).alias("kit"), F.coalesce(accessory, F.lit(False)).alias("accessory")))
    bare_titles = out.filter((F.size("models") == 0) & F.col("t").isNotNull())
    if not bare_titles.isEmpty():
        out = out.filter(F.size("models") > 0).unionByName(_word_models(out, bare_titles))
    return out.drop("t")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[^a-z0-9]+"), lambda w: F.length(w) > 1))


def _word_models(all_: DataFrame, bare: DataFrame) -> DataFrame:
    """`bare` titles (no code) with one model: their words that belong to a brand, in order of the alphabet; all their words if none does.

    So titles that differ in general words only are one item, and equal titles are one in any case. Blank titles have none.
    """
    word = F.explode(_words(F.col("t"))).alias("word")
    by_brand = all_.filter(F.col("brand").isNotNull()).select("brand", word).groupBy("word", "brand").agg(F.count("*").alias("n"))
    share = by_brand.groupBy("word").agg((F.max("n") / F.sum("n")).alias("share"))
    asked = bare.select("id", word)
    found = lookup(asked, "word", share, "share", hot_keys(asked, "word"))
    general = F.col("word").rlike(rf"^(?:{KINDS}|{NO_MODEL}|\d+[a-z]*)$") | (F.coalesce("share", F.lit(1.0)) < BRAND_SHARE)
    model = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.when(~general, F.col("word")))), " ").alias("special"), F.array_join(F.array_sort(F.collect_set("word")), " ").alias("all"))
    code = F.when(F.col("special") != "", F.col("special")).otherwise(F.col("all"))
    one = F.array(F.struct(code.alias("code"), F.lit("").alias("suffix"), F.lit(1).alias("pos")))
    return bare.join(model, "id").withColumn("models", one).select(*bare.columns)


def vote(profiles: DataFrame) -> DataFrame:
    """profiles (key, models, brand, size, kit, n) with `model`: the struct<code, suffix, pos> of each one's best combination."""
    one = profiles.select("key", "n", "brand", "size", "kit", F.explode("models").alias("m"))
    part = lambda c, text: F.when(c, F.array(text)).otherwise(F.array().cast("array<string>"))
    rest = F.concat(
        part(F.col("brand").isNotNull(), F.concat(F.lit("b:"), "brand")),
        part(F.col("m.suffix") != "", F.concat(F.lit("v:"), "m.suffix")),
        part(F.col("size").isNotNull(), F.concat(F.lit("c:"), F.col("size").cast("string"))),
        part(F.col("kit") > 1, F.concat(F.lit("k:"), F.col("kit").cast("string"))),
    )
    one = one.withColumn("rest", rest)
    # Mask 0 is the bare code, a candidate only where there is nothing to combine it with.
    masks = F.sequence(F.lit(0), F.shiftleft(F.lit(1), 4) - 1)
    fits = F.filter(masks, lambda k: (k < F.expr("shiftleft(1, size(rest))")) & ((k > 0) | (F.size("rest") == 0)))
    subset = lambda k: F.filter(F.transform("rest", lambda x, i: F.when(F.getbit(k, i) == 1, x)), lambda x: x.isNotNull())
    combined = one.select("key", "n", "m", F.explode(F.transform(fits, lambda k: F.concat_ws(" ", F.array(F.col("m.code")), subset(k)))).alias("combination"))
    stats = combined.groupBy("combination").agg(F.sum("n").alias("f"), F.try_divide(F.sum(F.col("m.pos") * F.col("n")), F.sum("n")).alias("at"))
    score = (F.length("combination") * F.log1p(F.col("f").cast("double")) / (F.col("at") + 1)).alias("score")
    scored = stats.select("combination", score)
    voted = lookup(combined, "combination", scored, "score", hot_keys(combined, "combination"))
    best = voted.groupBy("key").agg(F.max(F.struct("score", "combination", "m")).alias("best"))
    return profiles.join(best, "key").select(*profiles.columns, F.col("best.m").alias("model"), F.col("best.combination").alias("combination"))


def groups(listings: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, item): the item of each listing that has any words and is no accessory; equal items are the same.

    `listings` is (id, title, brand, model); nulls and blanks in any of them are allowed. A listing without a code is known
    by its words; one without a capacity, where others of its model have one, is an item of its own kind. Repeated ids count once.
    """
    t = cut(tokens(listings, reference).filter(~F.col("accessory") & (F.size("models") > 0)))
    plain = F.transform("models", lambda m: F.struct(m["code"].alias("code"), m["suffix"].alias("suffix")))
    digest = lambda seed: F.hex(F.xxhash64(F.lit(seed), F.to_json(plain), F.col("brand"), F.col("brand").isNull(), F.col("size"), F.col("kit")))
    t = t.withColumn("key", F.concat(digest(0), F.lit("-"), digest(1)))
    profiles = t.groupBy("key").agg(F.first("models").alias("models"), F.first("brand", ignorenulls=True).alias("brand"), F.first("size").alias("size"), F.first("kit").alias("kit"), F.count("*").alias("n"))
    voted = cut(vote(profiles))
    # Clusters are the profiles of one combination; those that agree in what is verified are merged by it.
    what = F.concat_ws("|", "model.code", "model.suffix", F.coalesce(F.col("size").cast("string"), F.lit("")), F.col("kit").cast("string"))
    clusters = voted.groupBy("combination", what.alias("what"), "brand").agg(F.min("key").alias("cluster"))
    brands = clusters.groupBy("what").agg(F.min("brand").alias("only"), F.max("brand").alias("most"))
    brand = F.coalesce("brand", F.when(F.col("only") == F.col("most"), F.col("only")), F.concat(F.lit("?"), F.col("cluster")))
    named = clusters.join(brands, "what").select("combination", "what", F.col("brand").alias("b"), F.concat_ws("|", brand, "what").alias("item"))
    own = voted.select("key", F.col("combination").alias("c"), what.alias("w"), "brand")
    items = own.join(named, (F.col("c") == F.col("combination")) & (F.col("w") == F.col("what")) & F.col("brand").eqNullSafe(F.col("b"))).select("key", "item")
    return lookup(t.select("id", "key"), "key", items, "item", hot_keys(t, "key")).select("id", "item").distinct()


def pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, of all members (id, item) with the same item. Large groups are paired in blocks."""
    sizes = members.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") > 1).withColumn("salts", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    sized = members.join(sizes.select("item", "salts"), "item")
    left = sized.select("item", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("s"))
    right = sized.select("item", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    return left.join(right, ["item", "s"]).filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
