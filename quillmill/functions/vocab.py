"""Fixed values that results depend on: word lists, ordered rules and patterns."""

# Stop words.
STOPWORDS = """
a an the and or but if then than that this these those of in on at to for from by with without
is are was were be been being do does did doing have has had having will would shall should can
could may might must not no nor so such as it its we our you your they their he she his her
which who whom whose what when where why how all any both each few more most other some only own
same too very s t just don now also however therefore thus hence although though while whereas
about into over under between within during before after above below up down out off again further
one two three four five six seven eight nine ten new using used use based results result show shows
shown proposed method methods approach approaches paper work works model models data set table figure
可以 我们 你们 他们 这个 那个 这些 那些 以及 并且 但是 因为 所以 因此 如果 那么 就是 不是 没有
一个 一种 一些 我们 方法 模型 结果 数据 表格 图 论文 本文 提出 使用 通过 进行 能够 可以 需要 由于
""".split()

# Cells that hold no number.
PLACEHOLDERS = ["-", "--", "—", "n/a", "na", "nan", "none", "", "?", "tbd"]

# Heading kinds, the first contained word decides.
HEADING_KINDS = [
    ("abstract", "abstract"),
    ("introduction", "introduction"),
    ("related work", "related_work"),
    ("background", "background"),
    ("preliminar", "background"),
    ("method", "method"),
    ("approach", "method"),
    ("model", "method"),
    ("algorithm", "method"),
    ("architecture", "method"),
    ("experiment", "experiment"),
    ("evaluation", "experiment"),
    ("result", "experiment"),
    ("ablation", "experiment"),
    ("discussion", "discussion"),
    ("conclusion", "conclusion"),
    ("outlook", "conclusion"),
    ("future work", "conclusion"),
    ("limitation", "discussion"),
    ("reference", "references"),
    ("bibliograph", "references"),
    ("appendix", "appendix"),
    ("摘要", "abstract"),
    ("引言", "introduction"),
    ("相关工作", "related_work"),
    ("方法", "method"),
    ("实验", "experiment"),
    ("结果", "experiment"),
    ("结论", "conclusion"),
    ("展望", "conclusion"),
    ("不足", "discussion"),
    ("局限", "discussion"),
    ("参考文献", "references"),
    ("附录", "appendix"),
]

# Figure kinds by caption words; plots come before architectures.
PLOT_WORDS = ["accuracy", "loss", "curve", "comparison", "results", "performance", "精度", "结果", "对比"]
ARCHITECTURE_WORDS = ["architecture", "framework", "overview", "pipeline", "workflow", "结构", "框架", "流程"]

# Words that place a link, and words of a code statement.
DATASET_WORDS = ["dataset", "data set", "data available", "data is available", "zenodo", "figshare", "huggingface", "kaggle", "dryad", "openml", "数据"]
DATASET_HOSTS = ["zenodo", "figshare", "huggingface", "kaggle", "dryad", "openml"]
CODE_WORDS = ["code", "implementation", "source code", "released", "available at", "github", "repository", "repo", "开源", "代码"]
CODE_NOUNS = ["code", "implementation", "source code", "repository", "repo", "github", "gitlab", "script", "代码", "开源"]
RELEASE_VERBS = ["available", "release", "released", "open-source", "open source", "开源", "公开", "已发布", "提供"]

# Pseudocode marks.
PSEUDO_INFO = ["algorithm", "pseudo", "pseudocode", "algo", "alg"]
REAL_LANGUAGES = ["python", "py", "java", "cpp", "c", "js", "javascript", "ts"]
PSEUDO_WORDS = [
    "for ", "while ", "if ", "end for", "end while", "end if", "return", "input", "output", "input:", "output:",
    "require", "ensure", "←", "<-", "procedure", "function", "repeat", "until", "do",
]

# An algorithm's intent, the first rule with a contained word decides.
INTENTS = [
    ("topk", ["top-k", "top k", "topk", "argmax", "前 k", "最大的 k", "select the largest", "空 min-heap", "min-heap"]),
    ("sort", ["sort", "sorting", "排序", "merge sort", "quicksort", "bubble"]),
    ("sum", ["sum", "summation", "求和", "累加", "average", "mean", "均值"]),
    ("count", ["count", "frequency", "histogram", "计数", "频次"]),
    ("normalize", ["softmax", "normalize", "归一化", "概率分布"]),
    ("distance", ["distance", "similarity", "euclidean", "cosine", "距离", "相似度"]),
    ("matmul", ["matrix multipl", "matmul", "矩阵乘"]),
]

# Patterns.
NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?%?"
PLUS_MINUS = r"([-+]?\d+(?:\.\d+)?)\s*(?:±|\+-|\+/-)\s*(\d+(?:\.\d+)?)"
WORD = r"[a-z][a-z\-]{1,}"
CJK = r"[\x{4e00}-\x{9fff}]"
CJK_WORD = r"[\x{4e00}-\x{9fff}]{2,6}"
TOTAL_ROW = r"(?iU)^\s*(?:total|overall|sum|average|avg|mean|weighted\s+average|汇总|总计|合计|平均|总体|总和)\b"
OURS_ROW = r"(?i)(ours?|our\s|ourselves|本文|我们|本方法|proposed|this\s+work)"
SHARE_COLUMN = r"(?i)(share|proportion|percent|pct|distribution|composition|fraction|占比|比例|份额|分布|比重|构成)"
COUNT_COLUMN = r"(?iU)(count|number|num_|_num|\bsize\b|\bn\b|n_|数量|样本数|计数|个数)"
SEPARATOR_ROW = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
PIPE_ROW = r"^\s*\|.*\|\s*$"
TABLE_CAPTION = r"(?i)^\s*\*{0,2}\s*(Table|TABLE|表)\s*((?:S-?)?(?:[0-9]+|[IVXLCDM]+))\s*[.:：、]?\s*(.*)$"
FIGURE_CAPTION = r"(?i)^\s*\*{0,2}\s*(Figure|Fig\.?|FIG\.?|图)\s*(S?\d+[a-zA-Z]?)\s*[.:：、]?\s*(.*)$"
ALGORITHM_CAPTION = r"(?i)^\s*\*{0,2}\s*(Algorithm|Alg\.?|算法|Procedure|Pseudocode)\s*([0-9]+[a-zA-Z]?)\s*[.:：、]?\s*(.*)$"
ALGORITHM_TITLE = r"(?i)^\s*(?:Algorithm|Alg\.?|Procedure|Pseudocode|算法)\s*[0-9]*\s*[.:：]\s*(.+?)\s*$"
FENCE = r"^\s*```+\s*([A-Za-z0-9_+-]*)\s*$"
IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
URL = r"https?://[^\s\)\]\}>\"',;]+"
GITHUB = r"(?i)^https?://(?:www\.)?github\.com/[\w.\-]+/[\w.\-]+"
ATX_HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"

# Thresholds, speech rate and limits.
PASS_DELTA, WARN_DELTA = 0.05, 0.20
CHARS_PER_SECOND, SHORTEST_CUE, LONGEST_CUE, CUE_GAP = 4.6, 1.6, 28.0, 0.35
MAX_RECORDS, MAX_CELLS, DEFAULT_SCALE = 10_000, 2_000, 400
