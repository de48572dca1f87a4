"""Fixed character values of the orthography, as plain data."""

# The ten apostrophes of the project and its two letters made of them.
APOSTROPHES = "'`´‘’ʻʼʽʿ′"
TUTUQ = "ʼ"
OKINA = "ʻ"

# Letters that normalisation folds, old form and new form in the same order.
FOLD_FROM = "șȘǧǦıİһҺӯӮ"
FOLD_TO = "şŞğĞiIҳҲўЎ"

# JavaScript's white space, as a Java character class body.
JS_SPACE = r"\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
