"""Vocabularies and patterns that decide how cells and names are read."""

# Fixed values, in natural order.
AGG_KEYWORDS = ["計", "合計", "小計", "集計", "累計", "総計", "総合計", "合計額", "総数", "合算", "総額", "総和", "全国", "全体", "total", "subtotal", "grand total", "sum", "cumulative", "aggregate", "year-to-date", "ytd", "overall", "combined"]
AXIS_DELIMITERS = ["_", "-", "－", "／", "/"]
HIERARCHY_DELIMITERS = ["/", "／", ">", "＞", "・"]
NOTE_AGGREGATION = ["合計", "合算", "総計", "小計", "集計", "の計", "sum"]
NOTE_EXCLUSION = ["除く", "除いた", "除外", "を除"]
NOTE_REFERENCE = ["参照", "参考", "を見る", "については", "に記載"]
NOTE_ROW_PREFIXES = ["※", "＊", "*", "注）", "注)", "（注", "(注", "注意", "＜注", "<注", "note:", "NOTE:", "＊注", "*注", "作成日", "更新日", "最終更新日", "作成者", "出典", "集計日", "集計基準日", "公表日", "発行日", "調査日", "データ取得日", "対象期間", "単位", "備考"]
STAT_NA_MARKERS = ["x", "***", "**", "*", "-", "…", "－", "–", "―", "na", "n/a", "n.a.", "?"]
STAT_PLACEHOLDERS = ["***", "X", "x", "ｘ", "Ｘ", "－", "…"]
UCHI_PREFIXES = ["うち", "内数", "内訳", "再掲"]
VALUE_KEYWORDS = ["売上", "予算", "実績", "件数", "人数", "金額", "数量", "利益", "費用", "コスト"]
UNIT_VOCAB = [
    "人", "名", "千人", "万人", "円", "千円", "万円", "百万円", "億円", "兆円", "%", "％", "ha", "㎡", "m²", "km²", "m³", "平方メートル", "立方メートル", "m", "km", "cm", "mm", "t", "kg", "g", "トン", "kl", "l", "戸", "棟", "件", "社", "箇所", "か所", "ヶ所", "店", "台", "基", "千", "百万", "億", "万", "kw", "kwh", "mw",
    "persons", "person", "yen", "mil. yen", "thou. yen", "billion yen", "million yen", "1,000 yen", "percent", "ratio", "rate", "index", "ton", "tons", "square meters", "square meter", "cubic meters", "cubic meter", "number", "numbers", "cases", "units", "households", "establishments", "workers", "mil.", "thou.", "million", "billion", "thousand",
]
#: (pattern, kind, axis name), tried in order; matching ignores case.
TIME_PATTERNS = [
    (r"^\d{4}年\d{1,2}月$", "year_month", "年月"),
    (r"^\d{1,2}月$", "month", "月"),
    (r"^(19|20)\d{2}[-_ ]?Q[1-4]$", "fiscal_quarter", "四半期"),
    (r"^Q[1-4][-_ ]?(19|20)\d{2}$", "fiscal_quarter", "四半期"),
    (r"^Q[1-4]$", "quarter", "四半期"),
    (r"^第[1-4一二三四]四半期$", "quarter_ja", "四半期"),
    (r"^\d{4}年度[上下]期$", "fiscal_half", "半期"),
    (r"^\d{4}年度$", "fiscal_year", "年度"),
    (r"^\d{4}年$", "year", "年"),
    (r"^(19|20)\d{2}$", "year_num", "年"),
]
TIME_FALLBACK = "期間"
UNIT_SUFFIX = r"^(?<label>.+?)[\s　]*[（(\[]\s*(?<unit>[^()（）\[\]]{1,15})\s*[)）\]]\s*$"
TRAILING_BRACKETS = r"[\s　]*(?:[（(【〔「\[]\s*[^)）】〕」\]]*\s*[)）】〕」\]])+\s*$"
PLACEHOLDER_COLUMN = r"^(unnamed[:\s_]*\d+(\.\d+)?|列(_?\d+)?)$"
ENUMERATED_AGGREGATE = r"[・、,＋+].+[のをにおける]*(合計|内訳|合算|総計|小計|集計|含む|合わせた|除く|除外)"
UNIT_PERIOD_SUFFIX = r"[／/](日|月|年|週|時|day|month|year|week|hour|hr)$"
YEAR = r"(19|20)\d{2}"
ENTITY_SPLIT = r"[、，,・／/＋+及びおよびとや]+"
NOTE_AGG_SUFFIX = r"[のをにおける]*(合計|合算|総計|小計|集計|計)\s*$"
EMPTY_HEADER = "列"
VALUE_COLUMN = "値"
TOLERANCE, RELATIVE = 1e-6, 0.01
