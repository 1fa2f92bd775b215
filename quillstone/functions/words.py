"""Word lists and tables of the text functions."""

# Results depend on these exact lists.
STOPWORDS = (
    "a an the and or of to for from in on at by with without is are was were be been being this that these those very how "
    "what when where why who which let mut pub fn impl self super crate use mod async await return match if else while loop true false some none ok err"
).split()
SCAFFOLD = (
    "can could you your my me do did have please remind remember previous previously conversation chat again before exactly said "
    "told suggest suggested recommend recommended tips advice"
).split()
PREFERENCE_WORDS = "prefer preferred preference favorite favourite recommend recommended suggest suggested advice tips concern".split()
PREFERENCE_SPANS = ("i prefer", "i'd prefer", "i would prefer", "i like", "i love", "i hate", "i avoid", "i want", "i need", "my favorite", "my favourite", "important to me", "my concern")
CONCEPTS = {
    "handle": "handle process execute dispatch perform run",
    "player": "player user client gamer account",
    "first": "first initial initially earliest new",
    "join": "join login logon signin signon authenticate authentication enter connect connection",
    "create": "create add insert build make",
    "delete": "delete remove erase destroy",
    "fetch": "fetch get retrieve load read",
    "update": "update modify change edit write",
    "error": "error failure exception fault",
    "config": "config configuration settings preferences",
}
CANONICAL = {word: name for name, group in CONCEPTS.items() for word in group.split()}
KINDS = ("code", "conversation", "documentation", "diary", "prose", "unknown")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
LANGUAGES = {
    "rust": "rs",
    "python": "py",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts tsx",
    "go": "go",
    "java": "java",
    "kotlin": "kt kts",
    "swift": "swift",
    "ruby": "rb",
    "php": "php",
    "c": "c h",
    "cpp": "cc cpp cxx hpp",
    "csharp": "cs",
    "shell": "sh bash zsh",
}
CODE_EXTENSIONS = "c cc cpp cxx cs go h hpp java js jsx kt kts mjs php py rb rs sh swift ts tsx zsh".split()
DOC_EXTENSIONS = "md mdx rst adoc asciidoc".split()
DOC_PREFIXES = "readme prd adr changelog".split()
CHAT_MARKERS = "session conversation transcript chat".split()
