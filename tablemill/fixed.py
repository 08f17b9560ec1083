"""Fixed values shared with every other reader of these results.

Word lists, patterns, palettes and texts below have to be equal everywhere the
results are compared, so they are stated plainly and in one place. Nothing in
this module computes anything.
"""

# ---------------------------------------------------------------- fixed values: tags
FORMATTING_TAGS = [
    "b", "strong", "i", "em", "u", "s", "strike", "del", "ins", "mark", "small", "sub", "sup", "code", "kbd",
    "samp", "var", "pre", "span", "font", "br", "wbr", "dfn", "div", "h1", "h2", "h3", "h4", "h5", "h6", "h7",
    "h8", "h9", "p", "abbr",
]
CELL_TAGS = ["td", "th"]
FORM_TAGS = ["input", "button", "select", "textarea"]
INPUT_TAGS = ["input", "select", "textarea"]

# ---------------------------------------------------------------- fixed values: empty cells
NO_DATA_VALUES = ["", "-", "—", "n/d", " ", "н/д", "н/a", "N/A", "n/a", "NA"]

# ---------------------------------------------------------------- fixed values: patterns
# Written in the dialect in which they were published (Unicode \b \s \d); see
# functions/regex.py for how they reach the JVM. Order matters everywhere.
DATE_PATTERNS = [
    r"\b\d{1,4}[-/.\\ ]\d{1,2}[-/.\\ ]\d{1,4}\b",
    r"\b(?:\d{1,2}\s+)?(январ[ьяь]|феврал[ьяь]|март[а]?|апрел[ья]|ма[йя]|июн[ьяь]|июл[ьяь]|август[а]?|сентябр[ьяь]|октябр[ьяь]|ноябр[ьяь]|декабр[ьяь])\.?,?\s+\d{2,4}\b",
    r"\b(?:\d{1,2}\s+)?(янв|фев|мар|апр|май|июн|июл|авг|сен|окт|ноя|дек)\.?\s+\d{2,4}\b",
    r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{4}\s+(January|February|March|April|May|June|July|August|September|October|November|December)(?:\s+\d{1,2})?\b",
    r"^\s*(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)\.?\s*['’]\d{2}\s*$",
]
TIME_PATTERNS = [
    r"\b\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\b",
    r"\b\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM|am|pm)\b",
]
MONEY_PATTERNS = [
    r"[$€£¥₽]\s*\d{1,3}([,\s]\d{3})*([.,]\d{1,2})?",
    r"\d{1,3}([,\s]\d{3})*([.,]\d{1,2})?\s*[$€£¥₽]",
    r"\d{1,3}([,\s]\d{3})*([.,]\d{1,2})?\s+(USD|EUR|GBP|JPY|RUB|usd|eur|gbp|jpy|rub|руб|р|руб.)\b",
]
PERCENT_PATTERN = r"\d+([.,]\d+)?\s*%"
UNITS = (
    "мм|см|м|км|mm|cm|m|km|миллиметр|сантиметр|метр|километр|millimeter|centimeter|meter|kilometer|"
    "дюйм|дюйма|дюймов|фут|фута|футов|ярд|ярда|ярдов|миля|мили|миль|inch|inches|in|ft|foot|feet|yard|yards|yd|mile|miles|mi|"
    "м²|см²|км²|мм²|sq m|sq cm|sq km|sq mm|square meter|square centimeter|"
    "л|мл|литр|литра|литров|миллилитр|миллилитра|миллилитров|l|ml|liter|liters|milliliter|milliliters|"
    "г|г/л|кг|т|мг|грамм|грамма|граммов|килограмм|килограмма|килограммов|тонн|тонна|тонны|g|kg|mg|ton|tons|tonne|tonnes|gram|grams|kilogram|kilograms|"
    "°C|°F|°K|градус|градуса|градусов|celsius|fahrenheit|kelvin|"
    "Вт|кВт|МВт|ватт|ватта|ваттов|киловатт|киловатта|киловаттов|w|kw|mw|watt|watts|kilowatt|kilowatts|"
    "В|в|вольт|вольта|вольтов|v|volt|volts|"
    "А|а|ампер|ампера|амперов|a|amp|amps|ampere|amperes|"
    "Гц|гц|герц|герца|герцов|hz|hertz|"
    "Па|па|паскаль|паскаля|паскалей|pa|pascal|pascals|"
    "бит|бита|битов|байт|байта|байтов|кб|мб|гб|тб|kb|mb|gb|tb|byte|bytes|kilobyte|megabyte|gigabyte|terabyte"
)
MEASUREMENT_PATTERN = r"^\s*(\d+([.,]\d+)?\s*(" + UNITS + r")\b)\s*$"
DIMENSION_PATTERNS = [
    r"^\s*-?\s*\d+\s*$",
    r"^\s*-?\s*\d+[.,]\d+\s*$",
    r"^\s*-?\s*\d+(?:\s+\d+)+\s*$",
    r"^\s*-?\s*\d+(?:\s+\d+)*\s+\d+[.,]\d+\s*$",
    r"^\s*[+-]?[.,]\d+\s*$",
    r"^\s*-?\s*\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*$",
    r"^\s*-?\s*\d{1,3}(?:\.\d{3})+(?:,\d+)?\s*$",
]

# ---------------------------------------------------------------- fixed values: types and roles
COARSE_OF_DETAIL = {
    "GENUINE": ["DATE", "TIME", "MONEY", "PERCENT", "MEASUREMENT", "DIMENSION"],
    "FORM": ["BUTTON", "INPUT_BOX"],
    "STRING": ["STRING"],
    "MEDIA": ["PHOTO", "VIDEO", "AUDIO", "MIXED"],
    "NO_DATA": ["NO_DATA"],
    "LINK": ["LINK"],
}
SUMMABLE_TYPES = ["DIMENSION", "MONEY", "PERCENT", "MEASUREMENT"]
TOP_HEADER_TYPES = ["STRING", "NO_DATA", "LINK"]
HEADER_TYPES = ["GENUINE", "STRING", "LINK"]

# ---------------------------------------------------------------- fixed values: features and labels
FEATURES = ["numeric", "form", "string", "media", "other", "no_data", "link"]
FEATURE_OF_TYPE = {
    "GENUINE": "numeric", "FORM": "form", "STRING": "string", "MEDIA": "media",
    "OTHER": "other", "NO_DATA": "no_data", "LINK": "link",
}
GENUINE_LABEL = "genuine"
NOT_GENUINE_LABEL = "no genuine"
UNLABELLED = "None"

# ---------------------------------------------------------------- fixed values: verdict texts
# {0}, {1}.. are filled by operators/verdict.py; {H} is the role being read.
VERDICT_TEXTS = {
    "small": "Таблица слишком малого размера {0} на {1}",
    "two_rows": "Таблица должна иметь минимум 2 строки ({H} + данные)",
    "no_role": "В первой строке нет ячеек роли <<{H}>>: все они размечены предыдущей стадией",
    "bad_type": 'Ячейка-{H}: "{0}" имеет неправильный тип DataType.{1}',
    "head_short": 'Недостаточно ячеек в строке {0}: ожидалось покрытие ячейки "{1}"',
    "head_wide": 'Ячейка "{0}" (colspan={1}) выходит за границы родительской ячейки "{2}" (colspan={3})',
    "jagged_block": 'Блок роли <<{H}>> зубчатый: ячейка данных "{0}" находится правее ячейки блока',
    "head_left": "Несоответствие структуры в строке {0}: обработано {1} из {2} ячеек, {3} из {4} родителей",
    "head_only": "В таблице нет ячеек данных - только заголовки",
    "side_only": "В таблице нет ячеек данных - только боковики",
    "jagged_head": 'Заголовки "зубчатые": ячейка-заголовок "{0}" выступает за строку {1} (rowspan={2})',
    "close_short": 'Недостаточно ячеек данных в строке {0}: ожидалось покрытие ячейки "{1}"',
    "close_width": 'Заголовки "зубчатые": ячейка данных "{0}" (colspan={1}) не соответствует заголовку "{2}" (colspan={3})',
    "close_left": "Несоответствие структуры в строке {0}: обработано {1} из {2} ячеек",
    "jagged_side": 'Боковики "зубчатые": ячейка-боковик "{0}" выступает за строку {1} (rowspan={2})',
    "side_width": 'Боковики "зубчатые": ячейка данных "{0}" (colspan={1}) не соответствует боковику "{2}" (colspan={3})',
    "no_data_rows": "В таблице нет строк с данными",
    "data_short": 'Недостаточно ячеек в строке {0}: ожидалась дочерняя ячейка для "{1}"',
    "data_extra": "Лишние ячейки в строке {0}: обработано {1}, всего {2}",
    "overrun": 'Ячейка "{0}" имеет rowspan={1}, но таблица закончилась (выходит за пределы по вертикали)',
    "split_wide": 'Несоответствие colspan в строке {0}: потомки ячейки "{1}" (colspan={2}) в сумме шире родителя',
    "split_short": 'Несоответствие colspan в строке {0}: родительская ячейка "{1}" имеет colspan={2}, а потомки покрывают только {3}.',
    "total_width": "Перерез в строке {0} должен быть на всю ширину таблицы. Ожидается {1}, получено {2}",
    "total_label": 'в строке таблицы \n "{0} | " \n нет типа данных строка',
    "total_left": 'ячейка "{0}" с типом данных DetailedDataType.{1} в срезе не соответствует типу данных "DetailedDataType.NO_DATA"',
    "total_tail": 'ячейка "{0}" с типом данных DetailedDataType.{1} в срезе не соответствует ни пустой ячейке, ни числу',
    "column_type": 'Несовместимые типы данных в столбце:\n  Родительская ячейка: "{0}" (тип: DetailedDataType.{1})\n  Дочерняя ячейка: "{2}" (тип: DetailedDataType.{3})',
    "bad_row_span": "rowspan должен быть целым числом не меньше 0",
    "bad_col_span": "colspan должен быть целым числом больше 0",
}
ROLE_NOUNS = {"title": "заголовок", "sidebar": "боковик"}
NO_TABLE_TEXT = "в переданном коде нет таблицы"
NO_TABLE_IN_RECORD = "Тег <table> не найден в html_text."
MODEL_REJECTED_TEXT = "эвристика пропустила, модель отклонила"
PROGRAM_ERROR_TEXT = "ошибка программы: "

# ---------------------------------------------------------------- fixed values: descriptions
ROLE_TEXTS = {
    "title": "ячейка области заголовков",
    "sidebar": "ячейка области атрибутов",
    "data": "ячейка области данных",
    "result": "ячейка итоговой строки",
}
HINT_SUBTITLE = "Подзаголовок: "
HINT_TITLE = "Заголовок: "
HINT_SUBATTRIBUTE = "Податрибут: "
HINT_ATTRIBUTE = "Атрибут: "
HINT_TOTAL_LABEL = "подпись итоговой строки"
HINT_TOTAL_COUNT = "Агрегирует ячеек: "
HINT_TOTAL = "ячейка является агрегацией"
TYPE_LINE = "Тип данных: "
TYPES_LINE = "Типы данных внутри: "
TYPES_LINE_EMPTY = "нет данных"

# ---------------------------------------------------------------- fixed values: export and colours
EXPORT_FORMAT = "genuine-table/1"
SHEET_PREFIX = "Таблица_"
SHEET_FILL = {
    "title": "ADD8E6", "sidebar": "90EE90", "data": "000000",
    "result": "FFFF00", None: "FFC7CE",
}
SHEET_DATA_FONT = "FFFFFF"
PAGE_STYLE = {
    "title": "background:#add8e6;color:#000",
    "sidebar": "background:#90ee90;color:#000",
    "data": "background:#2b2b2b;color:#fff",
    "result": "background:#ffef66;color:#000",
}
#: Signs that may not stand in an attribute, in the order of replacing.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
PAGE_GENUINE_STYLE = "outline:3px solid #2e7d32"
PAGE_REJECTED_STYLE = "outline:2px dashed #d32f2f"
PAGE_GENUINE_TITLE = "подлинная"
PAGE_REJECTED_TITLE = "неподлинная: "
MISSING_RECORD = "<нет записи>"
MISSING_PREDICTION = "<нет>"
