"""Text operators as column expressions: quotes, grounding, languages, answers, intents, names, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers in words.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())} | {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
# Romanised Hindi words, Marathi marker words, digits of four scripts.
ROMANISED_HINDI = "haan haanji nahi nahin nahee kya mera meri mere mujhe hai hain hoon hun chahiye kaise kitna kitni aur lekin kyunki mein bhi ghar paisa naukri kisaan kisan yojna batao bataiye kripya aap apna apni".split()
MARATHI_MARKERS = "आहे आहेत नाही माझे माझी माझा मी होय आणि काय करा मला तुम्ही".split()
NATIVE_DIGITS = "०१२३४५६७८९٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹௦௧௨௩௪௫௬௭௮௯"
# Yes and no in five languages.
YES = ["हाँ", "हां", "हा", "जी", "जी हाँ", "जी हां", "होय", "हो", "haan", "haanji", "haa", "han ji", "haan ji", "ji haan", "ہاں", "جی", "جی ہاں", "ہاں جی", "ஆம்", "ஆமாம்"]
NO = ["नहीं", "नही", "ना", "जी नहीं", "नाही", "nahi", "nahin", "nahee", "nai", "ji nahi", "nahi ji", "نہیں", "جی نہیں", "نا", "இல்லை", "கிடையாது"]
# Words of chat messages.
GREETINGS = ["hi", "hello", "hey", "yo", "hiya", "howdy", "thanks", "thank you", "thankyou", "ty", "bye", "goodbye", "see ya", "ok", "okay", "cool", "great", "nice", "sup"]
ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "fifth": 5, "5th": 5, "sixth": 6, "6th": 6}
LOOKUP_PHRASES = ["tell me more", "more detail", "more about", "what about", "more info", "know more", "look at", "check", "select"]
ELIGIBILITY_PHRASES = ["am i eligible", "am i qualified", "do i qualify", "can i get this", "can i apply", "is this for me", "check my eligibility", "check eligibility", "eligibility for this", "eligible for this"]
DECLINES = ["prefer not to say", "prefer not to answer", "rather not say", "rather not answer", "rather not", "don't want to say", "dont want to say", "do not want to say", "don't want to answer", "do not want to answer", "not comfortable", "no comment", "skip", "pass", "private"]
STOPWORDS = "the a an for of and or to in on with this that one scheme yojana just tell me here please can you show give about check select is are it what which there my i".split()
# Categories by keyword.
CATEGORY_WORDS = {
    "farmers": ["farmer", "farming", "agricult", "krishi", "kisan", "crop", "irrigation", "horticult", "animal husbandry", "dairy", "fisher", "livestock", "kcc"],
    "students": ["student", "scholarship", "education", "school", "college", "shiksha", "vidya", "study", "tuition", "hostel", "university", "academic"],
    "women": ["women", "woman", "girl", "mahila", "beti", "widow", "mother", "maternity", "pregnan", "self help group", "shg", "kanya"],
    "health": ["health", "hospital", "medical", "arogya", "swasthya", "insurance", "treatment", "disease", "disability", "divyang", "ayushman", "chikitsa"],
    "housing": ["housing", "awas", " house", "home", "ghar", "shelter", "residen"],
}


def normalize_quote(text: Column) -> Column:
    """Lower case, dashes as hyphens, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "‑–—", "---"), r"\s+", " "))


def quote_is_verbatim(quote: Column, document: Column, least: int = 15) -> Column:
    """Whether a quote's pieces between ellipses, of `least` characters or more, all occur; without such, the whole quote."""
    q, d = normalize_quote(quote), normalize_quote(document)
    pieces = F.filter(F.transform(F.split(q, r"\.\.\.+|…"), F.trim), lambda s: F.length(s) >= least)
    return F.when(F.coalesce(quote, F.lit("")) == "", False).otherwise(F.when(F.size(pieces) > 0, F.forall(pieces, lambda s: F.contains(d, s))).otherwise(F.contains(d, q)))


def number_is_grounded(value: Column, document: Column) -> Column:
    """Whether a number occurs in a text: as digits, with commas removed, or as an English word."""
    d = normalize_quote(document)
    digits = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    word = F.element_at(F.create_map(*[x for w, n in reversed(NUMBER_WORDS.items()) for x in (F.lit(float(n)), F.lit(w))]), value.cast("double"))
    return F.contains(d, digits) | F.contains(F.replace(d, F.lit(","), F.lit("")), digits) | F.coalesce(F.contains(d, word), F.lit(False))


def value_is_grounded(value: Column, document: Column) -> Column:
    """number_is_grounded for tagged values: a bool never is; a string has to occur."""
    return F.when(value["kind"] == "bool", False).when(value["kind"] == "num", number_is_grounded(value["num"], document)).otherwise(F.contains(normalize_quote(document), normalize_quote(F.coalesce(value["str"], F.lit("none")))))


def has_mojibake(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("â")), F.lit(False))


def script_language(text: Column) -> Column:
    """ur, ta, deva (Hindi or Marathi), hi (romanised: two marker words or more), else en."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(*ROMANISED_HINDI))
    return F.when(text.rlike("[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"), "ur").when(text.rlike("[஀-௿]"), "ta").when(text.rlike("[ऀ-ॿ]"), "deva").when(F.size(words) >= 2, "hi").otherwise("en")


def devanagari_guess(text: Column) -> Column:
    return F.when(F.arrays_overlap(F.regexp_extract_all(text, F.lit("([ऀ-ॿ]+)"), F.lit(1)), F.array(*map(F.lit, MARATHI_MARKERS))), "mr").otherwise("hi")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, NATIVE_DIGITS, "0123456789" * 4)


def yes_no(text: Column) -> Column:
    """True, False or null; English is left to parse_boolean."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), "^[.!?।۔]+|[.!?।۔]+$", ""), r"\s+", " "))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def parse_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "y", "true", "1"), True).when(t.isin("no", "n", "false", "0"), False).otherwise(yes_no(text))


def parse_number(text: Column) -> Column:
    """A number in any of the scripts' digits, or null: nothing is guessed."""
    t = ascii_digits(F.trim(text))
    return F.when(t.rlike(r"^[+-]?[0-9]+$|^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), t.try_cast("double"))


def is_decline(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), r"\s+", " ")), r"^[ .!]+|[ .!]+$", "")
    return t.rlike(r"(?<![\w'])(?:" + "|".join(DECLINES) + r")(?![\w'])")


def normalize_name(name: Column) -> Column:
    """Lower case without what stands in parentheses; a to z, 0 to 9 and single spaces."""
    t = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +", " "))


def content_tokens(text: Column) -> Column:
    """Distinct words of more than two characters that are no stopwords."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def message_intent(text: Column, has_current: Column | None = None, has_pending: Column | None = None, has_shortlist: Column | None = None) -> Column:
    """greeting, eligibility_request, answer, scheme_lookup or search, the first that fits. A missing flag is false."""
    current, pending, shortlist = (F.lit(False) if c is None else c for c in (has_current, has_pending, has_shortlist))
    t = F.regexp_replace(F.lower(F.trim(text)), "[!.,? ]+$", "")
    any_of = lambda phrases: F.lit(False) if not phrases else t.rlike("|".join(phrases))
    names = t.rlike(r"[0-9]+") & t.rlike(r"#\s*[0-9]+|\bnumber\s*[0-9]+|\b[0-9]+\b") | t.rlike(r"\b(?:" + "|".join(ORDINALS) + r")\b")
    return F.when(t.isin(*GREETINGS), "greeting").when(current & any_of(ELIGIBILITY_PHRASES), "eligibility_request").when(pending, "answer").when(shortlist & (any_of(LOOKUP_PHRASES) | names), "scheme_lookup").otherwise("search")


def categories_of(name: Column, description: Column) -> Column:
    """Categories whose keywords occur in name and description; none to several."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.array_compact(F.array(*[F.when(hay.rlike("|".join(words)), c) for c, words in CATEGORY_WORDS.items()]))


def token_estimate(text: Column) -> Column:
    """Tokens of a text at 3.5 characters each."""
    return F.length(text) / 3.5


def cautious_tokens(text: Column) -> Column:
    """Tokens with other than ASCII characters at 1.5 each, plus one."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return ascii_ / 3.5 + (F.length(text) - ascii_) / 1.5 + 1


def completion_budget(fixed: Column, total: int = 8000, margin: int = 150, least: int = 500, most: int = 4000) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(total - margin) - fixed))


def source_text(*parts: Column) -> Column:
    """The non-blank parts joined by blank lines."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), "\n\n")


def display_label(label: Column, field: Column) -> Column:
    words = F.replace(field, F.lit("_"), F.lit(" "))
    return F.coalesce(label, F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 30)))


def fails(text: Column, name: Column) -> Column:
    """Why a generated question is not plausible: an array of reasons, empty if it is."""
    digits = F.array_except(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1)))
    return F.array_compact(F.array(F.when(~F.length(text).between(8, 160), "length"), F.when(~text.rlike(r"\?$"), "no question mark"), F.when(text.rlike("\n"), "lines"), F.when(text.rlike("[₹$€%]"), "currency or percent"), F.when(F.size(digits) > 0, "digits")))


def translation_faults(source: Column, text: Column) -> Column:
    """Why a translation is not accepted: an array of reasons, empty if it is."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\{[a-z_]*\})"), F.lit(1)))
    stars = lambda c: F.regexp_count(c, F.lit(r"\*\*"))
    return F.array_compact(F.array(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty"), F.when(marks(source) != marks(text), "placeholders"), F.when(stars(source) != stars(text), "bold marks"), F.when(source == text, "same as source")))


# Words of questions about a whole household.
HOUSEHOLD_WORDS = "family|families|household|anyone|any one of|any member|members|husband|wife|spouse|children|relatives?"


def is_household_phrased(question: Column) -> Column:
    """Whether a question asks about the whole family."""
    return question.rlike(rf"(?i)\b({HOUSEHOLD_WORDS})\b")


def term_search(text: Column, term: str, around: int = 160, apart: int = 300) -> Column:
    """struct<hits, windows>: how often a term occurs in any case, and what stands around those hits that are `apart` from the last shown.

    White space is made single spaces first; windows reach `around` characters to either side.
    """
    t = F.regexp_replace(text, r"\s+", " ")
    gaps = F.split(F.lower(t), "\\Q" + term.lower() + "\\E", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(-apart - 1).alias("last"), F.expr("CAST(array() AS ARRAY<INT>)").alias("kept"))

    def step(acc: Column, gap: Column) -> Column:
        at = acc["at"] + F.length(gap)
        near = at - acc["last"] < apart
        return F.struct((at + len(term)).alias("at"), F.when(near, acc["last"]).otherwise(at).alias("last"), F.when(near, acc["kept"]).otherwise(F.array_append(acc["kept"], at)).alias("kept"))

    kept = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, step, lambda acc: acc["kept"])
    low = lambda at: F.greatest(at - around, F.lit(0))
    windows = F.transform(kept, lambda at: F.substr(t, low(at) + 1, at + len(term) + around - low(at)))
    return F.struct((F.size(gaps) - 1).alias("hits"), windows.alias("windows"))


def profile_text(members: Column) -> Column:
    """A profile as lines of prompt text: the applicant's facts, then each family member's; booleans as yes and no."""

    def line(e: Column) -> Column:
        v = e["value"]
        number = F.when(v["num"] == F.floor(v["num"]), F.floor(v["num"]).cast("string")).otherwise(v["num"].cast("string"))
        said = F.when(v["kind"] == "bool", F.when(v["num"] == 1, "yes").otherwise("no")).when(v["kind"] == "num", number).otherwise(F.coalesce(v["str"], F.array_join(v["arr"], ", "), F.lit("none")))
        return F.concat(F.lit("  - "), e["key"], F.lit(": "), said)

    def block(m: Column, i: Column) -> Column:
        head = F.when(m["ix"] == 0, "The applicant:").otherwise(F.concat(F.lit("Family member "), i, F.lit(":")))
        return F.array_join(F.concat(F.array(head), F.transform(F.map_entries(m["facts"]), line)), "\n")

    own, rest = F.filter(members, lambda m: m["ix"] == 0), F.filter(members, lambda m: m["ix"] != 0)
    lines = F.concat(F.when(F.size(own) > 0, F.transform(own, lambda m: block(m, F.lit(0)))).otherwise(F.array(F.lit("The applicant:"))), F.transform(rest, lambda m, i: block(m, i + 1)))
    empty = (F.size(rest) == 0) & F.forall(own, lambda m: F.size(m["facts"]) == 0)
    return F.when(empty, "The applicant:\n  (no facts recorded)").otherwise(F.array_join(lines, "\n"))
