"""Names, sizes and texts that results must agree on."""

# fixed values: splits, classes and sample sizes
SPLITS = ("train", "valid", "test")
CLASSES = ("1", "2", "3")
TEACHER_SAMPLES = {"train": 5, "valid": 5, "test": 5}
DRAWS_PER_SPLIT = {"train": 8000, "valid": 1000, "test": 1000}
MAX_DRAW_SIZE = 1024
EVAL_SAMPLES = 100
CALIBRATION_SAMPLES = 3
SCORE_BATCH = 1024

# fixed values: fingerprints
NUM_PERM = 64
LSH_BANDS = 3
LSH_ROWS = 21
HASH_SIDE = 8

# fixed values: prompts and chat texts
SYSTEM_PROMPT = "You are a helpful assistant."
USER_PROMPT = "What is the content of this image?"
IMAGE_TAG = "<image>"
DATA_URI_PREFIX = "data:image/jpeg;base64,"

# fixed values: application
START_BALANCE = 100
PURCHASE_CREDIT = 50
GENS_PER_PAGE = 10
KEYS_PER_PAGE = 20
PREVIEW_CHARS = 100
MAX_B64_CHARS = 20 * 1024 * 1024
MAX_SIDE = 4096
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff")
MSG_NO_URL = "No image URL provided"
MSG_BAD_URL = "Invalid image URL"
MSG_NOT_IMAGE = "URL does not point to an image"
MSG_BAD_SUFFIX = "Invalid file type. Please upload an image."
MSG_NOT_DECODABLE = "Image cannot be decoded"
MSG_TOO_LARGE = "File size exceeds 20MB limit."
MSG_TOO_WIDE = "Image dimensions exceed 4096x4096 pixels limit."

# fixed values: drawing
INK_MARGIN = 10
MIN_CANVAS = 3 * 28 * 28
MAX_CANVAS = 3 * 1280 * 28 * 28
ROTATE_MAX = 180

# fixed values: dataset manifest
DATASETS = {
    "sft": {
        "formatting": "sharegpt",
        "columns": {"messages": "conversations", "images": "images"},
    },
    "dpo": {
        "formatting": "sharegpt",
        "ranking": True,
        "columns": {
            "messages": "conversations",
            "chosen": "chosen",
            "rejected": "rejected",
            "images": "images",
        },
    },
}

# fixed values: one LaTeX token is a command or any single character
LATEX_TOKEN = (
    r"\\(?:mathbb\{[a-zA-Z]\}|begin\{[a-z]+\}|end\{[a-z]+\}|operatorname\*|[a-zA-Z]+|[^\n])"
    r"|[\s\S]"
)
# one character, and one word; Java and Python read all three patterns alike
CHAR_TOKEN = r"[\s\S]"
WORD_TOKEN = r"[^ \t\n\x0b\f\r]+"
