"""Small tables with the awkward rows: nulls, empties, ties, repeats, long texts and extra columns of clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, size long, h string, line string"
ALPHA = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim"


def words(n: int, seed: int) -> str:
    pool = ALPHA.split()
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(pool[x // 65536 % len(pool)] + str(x // 256 % 97))
    return " ".join(out)


def row(doc_id, text, lang="en", source="s1", n_chars=0):
    return (doc_id, text, lang, source, n_chars, -1, None, -5, "x", "y")


def documents(spark):
    base = words(120, 1)
    edited = base.split()
    edited[60] = "changed"
    far = base.split()
    far[10:100:9] = ["other"] * 10
    rows = [
        row(1, base), row(2, base.upper(), source="s2"), row(3, " ".join(edited), source="s3"), row(4, " ".join(far)), row(5, None), row(6, ""), row(7, " \n\t "), row(8, "one two three"), row(9, "One  two three"),
        row(10, words(30_000, 5), source=None, lang=None, n_chars=None), row(11, words(60, 9) + "\n" + "shared notice line that many sites carry about nothing at all here"), row(None, base), row(13, words(50, 3), source="ü"),
        row(13, words(50, 3), source="ü"), row(14, "naïve Ünïcode 日本語 😀 text\x1f with odd\x0bspaces", source="z"), row(15, "### *** $$$ %%% ||| " * 20), row(16, "the same eight words come again and again " * 30),
    ]
    rows += [row(100 + i, words(40, 100 + i) + "\nshared notice line that many sites carry about nothing at all here", source=f"t{i}") for i in range(6)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark).limit(0)


def save(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
