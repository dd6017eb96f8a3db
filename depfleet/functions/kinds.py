"""What kind of file a path is: category, language, technology, flags, decoded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import base_name, extension, stem

# fixed values: extension -> language
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".cjs": "JavaScript", ".py": "Python", ".dart": "Dart", ".ipynb": "Jupyter Notebook", ".java": "Java",
    ".go": "Go", ".cs": "C#", ".c": "C", ".cpp": "C++", ".cc": "C++", ".h": "C/C++ Header", ".hpp": "C++ Header",
    ".rb": "Ruby", ".php": "PHP", ".rs": "Rust", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell",
    ".ps1": "PowerShell", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".yaml": "YAML", ".yml": "YAML",
    ".json": "JSON", ".toml": "TOML", ".xml": "XML",
}
LANGUAGES_LITE = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript (React)", ".ts": "TypeScript",
    ".tsx": "TypeScript (React)", ".dart": "Dart", ".java": "Java", ".go": "Go", ".rs": "Rust", ".c": "C", ".h": "C",
    ".cpp": "C++", ".hpp": "C++", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".ipynb": "Jupyter Notebook",
    ".html": "HTML", ".css": "CSS", ".scss": "CSS", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".xml": "XML",
    ".toml": "TOML", ".md": "Markdown", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".csv": "Tabular Data",
    ".tsv": "Tabular Data",
}
TECHNOLOGIES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".py": "Python",
    ".java": "Java", ".go": "Go", ".cs": "C# / .NET", ".c": "C / C++", ".cpp": "C / C++", ".cc": "C / C++",
    ".rb": "Ruby", ".php": "PHP", ".rs": "Rust",
}
TECHNOLOGIES_LITE = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".py": "Python",
    ".dart": "Dart", ".java": "Java", ".go": "Go", ".rs": "Rust",
}
# fixed values: extensions, names and marks behind the categories
MODEL_EXT = (".pkl", ".pickle", ".dat", ".joblib", ".h5", ".onnx", ".pt", ".pth", ".tflite", ".safetensors")
DATA_EXT = (".csv", ".tsv", ".parquet", ".jsonl", ".sqlite", ".sqlite3", ".db")
MANIFEST_NAMES = (
    "docker-compose.yml", "docker-compose.yaml", "dockerfile", "package.json", "package-lock.json", "pnpm-lock.yaml",
    "yarn.lock", "requirements.txt", "pyproject.toml", "pipfile", "setup.py", "setup.cfg", "pom.xml", "build.gradle",
    "build.gradle.kts", "settings.gradle", "go.mod", "go.sum", "cargo.toml", "cargo.lock", "composer.json",
    "composer.lock", "gemfile", "gemfile.lock", "pubspec.yaml", "pubspec.lock", "manifest.json", "cmakelists.txt")
MANIFEST_EXT = (".csproj", ".sln", ".fsproj")
TEST_DIRS = ("/test/", "/tests/", "/__tests__/", "/spec/", "/specs/")
CONFIG_NAMES = ("tsconfig.json", "tsconfig.app.json", "tsconfig.node.json", "vite.config.ts", "vite.config.js",
                "webpack.config.js")
CONFIG_WORDS = ("config", "settings", "application", "properties", "env")
SCRIPT_EXT = (".sh", ".bash", ".ps1", ".bat", ".cmd")
DOC_EXT = (".md", ".markdown", ".rst", ".pdf", ".docx", ".pptx")
DOC_NAMES = ("readme", "readme.txt", "license", "license.txt", "contributing.md")
SOURCE_EXT = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".java", ".go", ".cs", ".c", ".cpp", ".cc", ".h", ".hpp",
    ".rb", ".php", ".rs", ".scala", ".kt", ".kts", ".swift", ".dart", ".sql", ".html", ".htm", ".css", ".scss",
    ".sass", ".less", ".ipynb")
BINARY_EXT = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib",
              ".class", ".pyc", ".pyo", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".mov", ".avi", ".bin", ".dat")
BINARY_EXT_LITE = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".mp4", ".pdf", ".zip", ".tar", ".gz", ".7z",
                   ".exe", ".dll", ".so", ".pyc", ".class", ".pkl", ".pickle", ".dat", ".h5", ".onnx", ".bin")
MANIFEST_NAMES_LITE = ("package.json", "requirements.txt", "pyproject.toml", "pom.xml", "build.gradle", "go.mod",
                       "cargo.toml", "pubspec.yaml", "composer.json", "gemfile", "dockerfile")
ASSET_EXT = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".mp4")
SOURCE_EXT_LITE = (".js", ".jsx", ".ts", ".tsx", ".py", ".dart", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs",
                   ".rb", ".php", ".ipynb", ".html", ".css", ".scss")


def _any(column: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(column, F.lit(word))
    return hit


def category(path: Column, profile: str = "full") -> Column:
    """Class of a file; the order of the tests is part of the meaning."""
    norm = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name, ext = base_name(norm), extension(norm)
    if profile == "lite":
        return (F.when(name.isin(*MANIFEST_NAMES_LITE) | name.startswith("docker-compose"), "manifest")
                .when((ext == ".env") | name.startswith(".env") | name.startswith(".git") | ext.isin(".ini", ".cfg")
                      | F.contains(norm, F.lit("/config/")) | norm.startswith("config/")
                      | _any(name, ("config", "setting")), "config")
                .when(ext.isin(".csv", ".tsv", ".parquet", ".arrow"), "dataset")
                .when(ext.isin(".pkl", ".pickle", ".dat", ".joblib", ".h5", ".onnx", ".pt", ".pth"), "model_artifact")
                .when(ext.isin(".md", ".rst", ".txt", ".pdf", ".docx", ".doc"), "documentation")
                .when(ext.isin(*ASSET_EXT), "asset").when(ext.isin(*SOURCE_EXT_LITE), "source").otherwise("other"))
    return (F.when(ext.isin(*MODEL_EXT), "model_artifact")
            .when(ext.isin(*DATA_EXT) | _any(norm, ("/datafiles/", "/datasets/")), "dataset")
            .when(name.isin(*MANIFEST_NAMES) | ext.isin(*MANIFEST_EXT), "manifest")
            .when(_any(norm, TEST_DIRS) | name.startswith("test_")
                  | F.endswith(name, F.concat(F.lit("_test"), ext)) | _any(name, (".test.", ".spec.")), "test")
            .when(name.startswith(".env") | ext.isin(".env", ".conf", ".ini", ".cfg") | name.isin(*CONFIG_NAMES)
                  | name.startswith(".eslint") | name.startswith(".prettier")
                  | (ext.isin(".yaml", ".yml", ".toml", ".json") & _any(name, CONFIG_WORDS)), "config")
            .when(ext.isin(*SCRIPT_EXT) | _any(norm, ("/scripts/", "/bin/")), "script")
            .when(ext.isin(*DOC_EXT) | name.isin(*DOC_NAMES) | _any(norm, ("/docs/", "/review/")), "documentation")
            .when(ext.isin(*SOURCE_EXT), "source").otherwise("other"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def language(path: Column, profile: str = "full") -> Column:
    return _lookup(LANGUAGES if profile == "full" else LANGUAGES_LITE, extension(path))


def technology(path: Column, profile: str = "full") -> Column:
    table, default = (TECHNOLOGIES, "Source Module") if profile == "full" else (TECHNOLOGIES_LITE, "Polyglot")
    return F.coalesce(_lookup(table, extension(path)), F.lit(default))


def is_binary(path: Column, profile: str = "full") -> Column:
    return extension(path).isin(*(BINARY_EXT if profile == "full" else BINARY_EXT_LITE))


TEST_MARKS = ("/test", "__test__", "spec", "scratch_test", "run_test", "test_", "/scripts/", "kustomize")  # fixed values


def is_test(path: Column) -> Column:
    low = F.lower(path)
    name = F.lower(stem(path))
    return (_any(low, TEST_MARKS) | low.startswith("test") | name.startswith("test") | name.startswith("scratch")
            | F.endswith(name, F.lit("_test")) | _any(name, (".test.", ".spec.")))


def line_count(content: Column, profile: str = "full") -> Column:
    """Lines of a text; the full profile counts none in an empty text."""
    n = F.size(F.split(content, "\n"))
    return F.when(content.isNull(), None).when((content == "") & F.lit(profile == "full"), 0).otherwise(n)


def fingerprint(content: Column) -> Column:
    """Mark by which a change shows: a digest of the whole content."""
    return F.sha2(content, 256)


def decode_text(data: Column) -> Column:
    """Text of raw bytes: UTF-16 by its mark, or by zero bytes that are many or that no UTF-8 has; else UTF-8, else Latin-1.

    The whole of the bytes decides: a stray zero byte in a UTF-8 text, wherever it stands, changes nothing.
    """
    mark = F.hex(F.substring(data, 1, 2))
    text = F.try_validate_utf8(data.cast("string"))
    raw = F.decode(data, "ISO-8859-1")
    zeros = F.length(raw) - F.length(F.replace(raw, F.lit("\u0000"), F.lit("")))
    wide = (zeros > 0) & (F.octet_length(data) % 2 == 0) & (text.isNull() | (10 * zeros >= F.length(raw)))
    return F.coalesce(F.when(mark.isin("FFFE", "FEFF"), F.decode(data, "UTF-16")).when(wide, F.decode(data, "UTF-16LE")), text, raw)
