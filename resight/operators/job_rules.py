"""Rule values for titles of job postings, for use with rules.RuleSets.  The personal, scope and unrelated sets are files in rule_values."""

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

from .rules import Rule, RuleSets, in_table

# Title patterns of student and trainee posts, in order.
STUDY = [
    r"\bintern(?:ship)?\b",
    r"\bpraktik(?:ant|um)?\b",
    r"\b(?:schuler|schul|pflicht|sommer)praktik(?:ant\w*|um)\b",
    r"\bwerks?student\w*\b",
    r"\bwerkstudier\w*\b",
    r"\bworking student\b",
    r"\bstudent(?:ische| assistant| helper)?\b",
    r"\bstudentenjob\b",
    r"\bthesis\b",
    r"\bmaster(?:arbeit|thesis)\b",
    r"\bmasterand\w*\b",
    r"\bpre[\s-]*master\b",
    r"\bbachelor(?:arbeit|thesis)\b",
    r"\bbachelorand\w*\b",
    r"\bbachelorstudium\b",
    r"^bachelor(?![\s-]*absolvent)\s*[-:]\s*",
    r"^bachelor[\s/-]+of[\s/-]+(?:science|arts|engineering)\b",
    r"\bdissertation\b",
    r"\bdoctoral\b",
    r"\bphd(?: student)?\b",
    r"\btrainee(?:ship|s|programm?\w*)?\b",
    r"\bausbildung\b",
    r"\bduales?(?: studium)?\b",
    r"\bstudium\b",
    r"\babschlussarbeit\b",
    r"\bvolontariat\b",
    r"\b(?:graduate|it)[-/ ]programme?\b",
    r"\blehre\b",
    r"\bstudien[-/ ]?abschlussarbeit\b",
    r"\bhiwi\b",
]

# Rules of wanted roles, in order.
TARGET = [
    (
        "data_science",
        "data_science",
        [
            r"\bdata[\s/-]*scientist\w*\b",
            r"\bdata[\s/-]+science\b",
            r"\bdecision[\s/-]+scientist\w*\b",
            r"\bapplied[\s/-]+scientist\w*\b",
            r"\b(?:machine[\s/-]+learning|ml)[\s/-]+scientist\w*\b",
            r"\b(?:bio)?statistiker\w*\b",
            r"\b(?:bio)?statistician\w*\b",
        ],
    ),
    (
        "analytics_bi",
        "analytics_bi",
        [
            r"\bdata[\s/-]+analyst\w*\b",
            r"\bdata(?:\s*/\s*|[\s/-]+)business[\s/-]+analyst\w*\b",
            r"\bdata[\s/-]+analytics\b",
            r"\banalytics\b",
            r"\banalytics[\s/-]+engineer\w*\b",
            r"\bbusiness[\s/-]+intelligence\b",
            r"\bpower[\s/-]+bi\b",
            r"\bbi[\s/-]+(?:analyst|developer|engineer|consultant)\w*\b",
            r"\bbi[\s/-]+manager\w*\b",
            r"\bconsultant[\s/-]+bi\b",
            r"\breporting[\s/-]+analyst\w*\b",
            r"\binsights?[\s/-]+analyst\w*\b",
            r"\bdata[\s/-]+visuali[sz]ation[\s/-]+analyst\w*\b",
            r"\bweb(?:site)?[\s/-]*analyst\w*\b",
            r"\bdatenanalyst\w*\b",
            r"\bdatenanalyse\w*\b",
            r"\bdatenanalytik\w*\b",
        ],
    ),
]

# Rules of technical roles beside the wanted ones, in order.
ADJACENT = [
    (
        "audited_target_engineering",
        "target_engineering",
        [
            r"\banalytics[\s/-]+engineer\w*\b",
            r"\bbusiness[\s/-]+intelligence[\s/-]+engineer\w*\b",
            r"\bbi[\s/-]+engineer\w*\b",
            r"\bbusiness[\s/-]+data[\s/-]+analyst\w*\b",
        ],
    ),
    (
        "data_engineering_adjacent",
        "data_engineering",
        [
            r"\bdata[\s/-]+engin(?:eer|eering)\w*\b",
            r"\bdata[\s/-]+(?:platform|warehouse|lake)[\s/-]+engineer\w*\b",
        ],
    ),
    (
        "ai_engineering_adjacent",
        "ai_engineering",
        [
            r"\bai[\s/-]+engineering\b",
            r"\bai[\s/-]+(?:delivery|solutions?|platform|computer[\s/-]+vision)[\s/-]+engineer\w*\b",
            r"\b(?:product|forward[\s/-]+deployed)[\s/-]+engineer\w*[^a-z0-9]+(?:ai|genai)\b",
            r"\bai[\s/-]+tech[\s/-]+consult\w*\b",
            r"\bconsult\w*[\s/-]+(?:genai|agentic[\s/-]+ai)\b",
        ],
    ),
]

# Titles of consulting, and of tools and platforms that it implements; employers whose postings are never wanted; and
# employers at which one kind of title belongs to retail.
CONSULTING = r"(?:\bconsult(?:ant|ants|ing|ancy)\w*\b|\b\w*berater(?:(?::|/)?in)?\w*\b|\b\w*beratung\w*\b|\badvisory\b)"
IMPLEMENTATION = (
    r"(?:\b(?:sap|sac|workday|prism|qlik|cognos|cubeware|databricks|snowflake|denodo|salesforce|servicenow|azure|aws|gcp)\b|"
    r"\b(?:power[\s/-]+platform|data[\s/-]+warehous\w*|data[\s/-]+lake|data[\s/-]+platform\w*|data[\s/-]+model(?:ing|ling)|process[\s/-]+mining|e[\s/-]*discovery|digital[\s/-]+forensics?)\b|"
    r"\b(?:olap|etl|sql|pl[\s/-]*sql)\b|\btechnical[\s/-]+consult\w*\b|\bsolutions?[\s/-]+consult\w*\b|\bconsult\w*[\s/-]+solutions?\b|\bforensic\w*\b|\bcloud\b)"
)
EMPLOYERS = ["university positions"]
AT_EMPLOYERS = [(["bucherer", "bucherer ag", "prada group"], ("retail_client_advisor", "retail_hospitality", [r"\bclient[\s/-]+advis(?:or|er)\w*\b"]))]


def read_rules(text: str) -> list[Rule]:
    """Rules from a file's text: lines `rule: family`, each followed by its patterns, indented; lines that begin with # are remarks."""
    out: list[Rule] = []
    for line in text.splitlines():
        if line[:1].isspace() and line.strip():
            out[-1][2].append(line.strip())
        elif line.strip() and not line.startswith("#"):
            rule, _, family = line.partition(":")
            out.append((rule.strip(), family.strip(), []))
    return out


def file_rules(name: str) -> list[Rule]:
    """The rules of one of this package's files: personal, scope or unrelated."""
    return read_rules((files(__package__) / "rule_values" / f"{name}.txt").read_text(encoding="utf-8"))


def job_rules(more: RuleSets | None = None) -> RuleSets:
    """All rule sets for titles of job postings; with `more`, its personal, scope and unrelated ones instead of the files'."""
    own = more or RuleSets(personal=file_rules("personal"), scope=file_rules("scope"), unrelated=file_rules("unrelated"))
    return RuleSets(
        target=TARGET, adjacent=ADJACENT, personal=own.personal, scope=own.scope, unrelated=own.unrelated, study=STUDY, keywords=own.keywords, stems=own.stems,
        employers=EMPLOYERS, at_employers=AT_EMPLOYERS, consulting=CONSULTING, implementation=IMPLEMENTATION, version=own.version,
    )


def rules_table(spark: SparkSession) -> DataFrame:
    """The five sets of rules and the lists of study and academic patterns as a table for rules.rule_tables()."""
    sets = job_rules()
    return in_table(spark, {**{s: getattr(sets, s) for s in ("target", "adjacent", "personal", "scope", "unrelated")}, **{s: [(s, s, getattr(sets, s))] for s in ("study", "academic")}})
