"""Utterances and the objects that they mean (L3 to L10, L12).

Everything is a Column expression or a join by model: an utterance meets the objects
of its model, whose words are worked out once an object, and what it means is found
without another exchange. A model costs its utterances times its objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The vocabulary of the rules.
SYNONYMS = {
    "windpipe": "trachea", "wind pipe": "trachea", "airway": "trachea", "airways": "trachea", "backbone": "vertebrae", "spine": "vertebrae", "spinal column": "vertebrae", "vertebra": "vertebrae",
    "ribcage": "rib", "rib cage": "rib", "ribs": "rib", "collarbone": "clavicula", "collar bone": "clavicula", "shoulder blade": "scapula", "breastbone": "sternum", "breast bone": "sternum",
    "upper arm": "humerus", "gullet": "esophagus", "oesophagus": "esophagus", "food pipe": "esophagus", "thyroid": "thyroid gland", "great vessels": "aorta", "vena cava": "vena cava", "voice box": "trachea",
}
CARDINALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
STOPWORDS = ("the", "a", "an", "please", "can", "you", "my", "his", "her", "and", "of", "on", "in", "to", "for", "me", "just", "now", "s")
FILLERS = ("um", "uh", "erm", "hmm", "okay", "ok", "so", "like")
HIGHLIGHT_VERBS = ("highlight", "mark", "colour", "color", "flag", "point out", "show me", "light up", "select")
CLEAR_VERBS = ("clear", "reset", "unhighlight", "remove highlight", "remove the highlight", "drop the highlight", "no highlight", "clear highlight")
VIEW_COMMANDS = (
    (r"\b(?:zoom|move|come|get)\s+(?:in|closer)\b|\bcloser\b|\bzoom\s*in\b|\bmagnify\b|\benlarge\b|\bbigger\b", "zoom_in"),
    (r"\bzoom\s*out\b|\b(?:zoom|move|back)\s+(?:out|away|off)\b|\bfurther\s+(?:out|away)\b|\bsmaller\b|\bwider\b|\bpull\s+back\b", "zoom_out"),
    (r"\b(?:reset|recenter|re center|centre|center|fit)\s+(?:the\s+)?(?:view|camera|hologram)\b|\bfit\s+to\s+(?:screen|view)\b", "reset_view"),
    (r"\b(?:stop|pause|freeze|halt)\s+(?:the\s+)?(?:spin\w*|rotat\w*|turning)\b|\bhold\s+still\b|\bstop\s+moving\b", "spin_off"),
    (r"\b(?:start|resume|keep)\s+(?:the\s+)?(?:spin\w*|rotat\w*)\b|\b(?:spin|rotate)\s+(?:it|the\s+\w+)?\s*(?:again)?\b", "spin_on"),
)
EVERYTHING_WORDS = ("everything", "all anatomy", "all structures", "whole model", "all objects", "the whole thing")
ABNORMAL_WORDS = ("abnormality", "abnormalities", "abnormal", "finding", "findings", "lesion", "lesions", "nodule", "nodules", "mass", "masses", "tumour", "tumor", "tumours", "tumors", "suspicious", "anything wrong", "region of interest", "regions of interest", "hot spot", "hot spots")
ABNORMAL_LABEL = "high.intensity|nodule|lesion|mass|tumou?r|unlabeled"
CONJUNCTIONS = r" (?:and|plus|also|as well as|along with|together with) "
LABEL_WORDS = {"vertebrae": "vertebra", "clavicula": "clavicle", "autochthon": "deep back muscle"}


def normalize_utterance(text: Column) -> Column:
    """Lower-case words between single spaces, with synonyms replaced and numbers as digits; a null text has none. Names of several words come first, then every single word by one look-up, then letters join their numbers. Keep the result as a column: what follows takes it from there."""
    phrases = {a: b for a, b in SYNONYMS.items() if " " in a}
    single = {a: b for a, b in SYNONYMS.items() if " " not in a} | {word: str(i) for words in (CARDINALS, ORDINALS) for i, word in enumerate(words, 1)}
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    named = plain
    for phrase, by in phrases.items():
        named = F.regexp_replace(named, rf"\b{phrase}\b", by)
    has_phrase = plain.rlike(rf"\b(?:{'|'.join(phrases)})\b")
    by_word = F.create_map(*(F.lit(x) for pair in single.items() for x in pair))
    words = F.transform(F.split(F.when(has_phrase, named).otherwise(plain), " "), lambda w: F.when(w.isin(*single), by_word[w]).otherwise(w))
    return F.regexp_replace(F.array_join(words, " "), r"\b([a-z]) ([0-9]{1,2})\b", "$1$2")


def stem(word: Column) -> Column:
    """Singular of a plural by its ending."""
    long = F.length(word) > 3
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    es = long & word.endswith("es") & ~word.endswith("ees")
    return F.when(es & cut(2).rlike("(s|x|ch|sh)$"), cut(2)).when(es | (long & word.endswith("s") & ~word.endswith("ss")), cut(1)).otherwise(word)


def tokens(normal: Column) -> Column:
    """Stems of the words that matter, of a normalized text."""
    return F.transform(F.filter(F.split(normal, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS, *FILLERS)), stem)


def label_tokens(label: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def side_of(words: Column) -> Column:
    return F.get(F.filter(words, lambda w: w.isin("left", "right")), F.lit(0))


def digits_of(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike("^[0-9]+$"))


def name_stems(label: Column) -> Column:
    """Stems of a label's words, but for its side."""
    return F.transform(F.filter(label, lambda w: ~w.isin("left", "right")), stem)


def coverage(spoken: Column, said: Column, numbers: Column, names: Column, own: Column, own_numbers: Column) -> Column:
    """``coverage_score`` from the words, side and numbers of what was said and of a label."""
    other_side = said.isNotNull() & (own.isNull() | (said != own))
    other_number = (F.size(numbers) > 0) & (F.size(own_numbers) > 0) & ~F.arrays_overlap(numbers, own_numbers)
    matched = F.size(F.filter(names, lambda w: F.array_contains(spoken, w)))
    score = matched / F.size(names) + F.when(said.isNotNull() & (said == own), 0.25).otherwise(0.0)
    return F.when(other_side | other_number | (matched == 0), 0.0).otherwise(score)


def coverage_score(spoken: Column, label: Column) -> Column:
    """Share of the label's words, but for its side, that were said; a quarter more where a side was said and agrees.

    0 where sides or numbers conflict, or where a side was said and the label has none.
    """
    names = name_stems(label)
    return coverage(spoken, side_of(spoken), digits_of(spoken), names, side_of(label), digits_of(names))


def split_clauses(normal: Column) -> Column:
    """Clauses of a normalized utterance, or the whole of it."""
    parts = F.filter(F.transform(F.split(normal, CONJUNCTIONS), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(normal))


def names_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(rf"\b(?:{'|'.join(words)})\b")


def semantic_group(clause: Column) -> Column:
    """``everything``, ``abnormalities`` or null."""
    return F.when(names_any(clause, EVERYTHING_WORDS), "everything").when(names_any(clause, ABNORMAL_WORDS), "abnormalities")


def view_action(normal: Column) -> Column:
    """What a view command asks for, first pattern first; null for other utterances."""
    return F.coalesce(*(F.when(normal.rlike(pattern), action) for pattern, action in VIEW_COMMANDS))


def classify_intent(normal: Column) -> Column:
    """``view``, ``clear``, ``highlight`` or ``unknown``, from the words of a normalized text alone."""
    says = lambda verbs: normal.rlike("|".join(verbs))
    return F.when(view_action(normal).isNotNull(), "view").when(says(CLEAR_VERBS), "clear").when(says(HIGHLIGHT_VERBS), "highlight").otherwise("unknown")


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with further columns. A filter on them is not carried back to where they are made, so each is worked out once a row."""
    for name, value in values.items():
        rows = rows.select("*", F.explode(F.array(value)).alias(name))
    return rows


def heard(utterances: DataFrame) -> DataFrame:
    """Utterances ``utterance_id, model_id, text`` with their ``normal`` text, what is ``said`` and the view ``action``, each worked out once a row."""
    normal = once(utterances, normal=normalize_utterance(F.col("text")))
    return once(normal, action=view_action(F.col("normal"))).withColumn("said", F.when(F.col("action").isNotNull(), "view").otherwise(classify_intent(F.col("normal"))))


def meanings(utterances: DataFrame, objects: DataFrame, every: bool) -> DataFrame:
    """``utterances`` (with ``clauses``) by clause and object that it scores with; ``meant`` are those of its best score, and of the first attempt that has any. If ``every``, an utterance without any has a row too.

    Utterances meet the objects of their model, and all that follows stays within the
    model: tables that are dealt by model are not dealt again.
    """
    by_model = Window.partitionBy("model_id")
    flagged, odd = F.col("obj_type").isin("finding", "lesion"), (F.col("obj_type") == "region") | F.lower("label").rlike(ABNORMAL_LABEL)
    known = objects.withColumn("reviewed", F.max(flagged).over(by_model)).where("obj_type is null or obj_type <> 'volume'")
    known = known.select("model_id", "object_id", "obj_seq", "label", F.coalesce(F.when(F.col("reviewed"), flagged).otherwise(odd), F.lit(False)).alias("odd"), label_tokens(F.col("label")).alias("words"))
    known = known.select("model_id", "object_id", "obj_seq", "label", "odd", (F.col("object_id") == F.min("object_id").over(by_model)).alias("leads"), name_stems(F.col("words")).alias("names"), side_of(F.col("words")).alias("own"))
    known = known.withColumn("own_numbers", digits_of(F.col("names")))

    clauses = utterances.select("*", F.posexplode_outer("clauses").alias("clause", "words"))
    following = F.get("clauses", F.col("clause") + 1)
    attempt = lambda i, words: F.struct(F.lit(i).alias("attempt"), words.alias("words"))
    tried = F.when(following.isNull(), F.array(attempt(0, F.col("words")))).otherwise(F.array(attempt(0, F.col("words")), attempt(1, F.concat_ws(" ", "words", following))))
    tries = clauses.withColumn("t", F.explode(tried)).drop("clauses", "words").select("*", "t.attempt", semantic_group(F.col("t.words")).alias("kind"), tokens(F.col("t.words")).alias("spoken")).drop("t")
    tries = tries.withColumns({"side": side_of(F.col("spoken")), "numbers": digits_of(F.col("spoken"))})

    met = tries.join(known, "model_id", "left" if every else "inner")
    named = coverage(*(F.col(c) for c in ("spoken", "side", "numbers", "names", "own", "own_numbers")))
    score = F.when(F.col("kind").isNull(), F.coalesce(named, F.lit(0.0))).otherwise(F.when(F.col("object_id").isNotNull() & ((F.col("kind") == "everything") | F.col("odd")), 1.0).otherwise(0.0))
    leads = (F.coalesce("clause", F.lit(0)) == 0) & (F.col("attempt") == 0) & F.coalesce("leads", F.lit(True))
    scored = once(met, score=score).where((F.col("score") > 0) | leads if every else F.col("score") > 0)
    scored = scored.withColumn("label", F.when(F.col("kind").isNull(), F.col("label"))).drop("kind", "spoken", "side", "numbers", "odd", "leads", "names", "own", "own_numbers")
    clause = ["model_id", "utterance_id", "clause"]
    best = scored.withColumn("hit", (F.col("score") > 0) & (F.col("score") >= F.max("score").over(Window.partitionBy(*clause, "attempt")) - 1e-9))
    first = F.min(F.when(F.col("hit"), F.col("attempt"))).over(Window.partitionBy(*clause))
    return best.withColumn("meant", F.col("hit") & (F.col("attempt") == first))


def resolve_clauses(utterances: DataFrame, objects: DataFrame) -> DataFrame:
    """``utterance_id, clause, object_id, label, obj_seq, score``: what each clause of ``utterance_id, model_id, normal`` (see ``heard``; an id is one utterance's) means in its model.

    All labels tied at the best score of a clause; a clause without any is tried
    again together with the one after it, which still counts for itself. Volumes
    are never meant.
    """
    told = utterances.select("utterance_id", "model_id", split_clauses(F.col("normal")).alias("clauses"))
    return meanings(told, objects, False).where("meant").select("utterance_id", "clause", "object_id", "label", "obj_seq", "score")


def resolve_utterances(utterances: DataFrame, objects: DataFrame) -> DataFrame:
    """``utterance_id, intent, action, targets``: view and clear commands mean no object; others highlight what their clauses mean, each object once, in order of clause and label."""
    still = F.col("said").isin("view", "clear")
    told = heard(utterances).select("utterance_id", "model_id", "said", "action", F.when(still, F.lit(None)).otherwise(split_clauses(F.col("normal"))).alias("clauses"))
    target = F.when(F.col("meant"), F.struct("clause", F.coalesce("label", F.lit("")).alias("label"), "obj_seq", "object_id"))
    found = meanings(told, objects, True).groupBy("model_id", "utterance_id").agg(F.first("said").alias("said"), F.first("action").alias("action"), F.sort_array(F.collect_list(target)).alias("targets"))
    intent = F.when(still, F.col("said")).when(F.size("targets") > 0, "highlight").otherwise("unknown")
    return found.select("utterance_id", intent.alias("intent"), "action", F.array_distinct(F.transform("targets", lambda x: x["object_id"])).alias("targets"))


def display_label(label: Column) -> Column:
    """A readable name for an identifier: its side first, a lobe after its lung, some words replaced, the first letter a capital. Other labels stay."""
    identifier = label.rlike("^[a-z0-9]+(_[a-zA-Z0-9]+)+$") | label.rlike("^[a-z]+$")
    parts = F.split(label, "_")
    side = F.get(F.filter(parts, lambda p: p.isin("left", "right")), F.lit(0))
    rest = F.filter(parts, lambda p: ~F.coalesce(p == side, F.lit(False)))

    def word(p: Column) -> Column:
        out = p
        for a, b in LABEL_WORDS.items():
            out = F.when(p == a, b).otherwise(out)
        return out

    words = F.transform(rest, word)
    lobe = F.array_position(words, "lobe")
    lung = F.concat(F.lit("lung · "), F.array_join(F.slice(words, F.lit(2), F.greatest(lobe.cast("int") - 2, F.lit(0))), " "), F.lit(" lobe"))
    name = F.when((F.get(words, F.lit(0)) == "lung") & (lobe > 1), lung).otherwise(F.array_join(words, " "))
    text = F.when(side.isNotNull(), F.concat_ws(" ", side, name)).otherwise(name)
    return F.when(identifier, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))).otherwise(label)
