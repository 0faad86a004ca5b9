"""Schemas, as DDL, of the tables that annotation tools and the engine's own stages exchange."""

TOKENS = "sentence_id int, token_id int, word string, lemma string, pos string, tag string, dep string, head_id int"
ENTITIES = "coref int, start_token int, end_token int, prop string, cat string, text string"
QUOTES = "quote_start int, quote_end int, mention_start int, mention_end int, mention_phrase string, char_id int, quote string"
NAMES = "id int, fullname string, firstname string, middlename string, surname string, gender string, aka string, profession string, status string"
SECTIONS = "division string, ord int, section string, tok_lo int, tok_hi int, sent_lo int, sent_hi int"
_WORDS = "array<struct<w:string,i:bigint>>"
_MENTIONS = "array<struct<n:string,c:bigint>>"
CHARACTERS = (
    "characters array<struct<id:bigint,count:bigint,g:struct<inference:map<string,double>,argmax:string,max:double,total:double>,"
    f"agent:{_WORDS},patient:{_WORDS},mod:{_WORDS},poss:{_WORDS},mentions:struct<proper:{_MENTIONS},common:{_MENTIONS},pronoun:{_MENTIONS}>>>"
)
#: Columns of a triple, in the order of its file layout.
TRIPLE_COLUMNS = [
    "source", "canonical_id_left", "name_left", "role_left", "word", "lemma", "index", "negated", "original_ids_left", "gender_left", "name_variants_left",
    "canonical_id_right", "name_right", "role_right", "original_ids_right", "gender_right", "name_variants_right",
]
EDGES = "source_id int, source_name string, target_id int, target_name string, weight bigint, sentence_ids array<int>"
OCCURRENCES = "canonical_id int, fullname string, count bigint, sentence_ids array<int>"
