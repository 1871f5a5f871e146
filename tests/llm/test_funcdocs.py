from lodelens.llm import funcdocs as D
from lodelens.llm import queries as Q

SCHEMA = "project_id string, rel_path string, chunk_id string, language string, symbol string, symbol_kind string, start_line int, end_line int, text string, owner string"


def one(text, family):
    found, _, _ = D.parse(text, family)
    return {f[0]: (D.meaning(f[2]).strip(), D.is_real(f[2], f[0])) for f in found}


def test_each_language():
    cases = [
        ("python", "@cached\nasync def load(a,\n  b: str = ')') -> dict[str, int]:\n\n    # note\n    r'''Reads the whole file\n    :param a: x\n    '''\n"), ("js", "/**\n * Reads the whole file again.\n * @param a it\n */\nexport async function load(a) {\n}"),
        ("js", "// Reads the whole file again.\nconst load = async (a: string): Promise<void> => {\n}"), ("js", "class A {\n  /** Reads the whole file again. */\n  @Memo()\n  private async load(a: string): void {\n  }\n}"),
        ("java", "class A {\n    /** Reads the whole file again. */\n    @Override\n    public int load(String a) throws E {\n    }\n}"), ("cs", "class A {\n    /// <summary>Reads the whole file again.</summary>\n    [Obsolete]\n    public int Load(int a) {\n    }\n}"),
        ("go", "/*\nReads the whole file again.\n*/\nfunc (s *S) Load(a int) error {\n}"), ("rust", "impl A {\n    #[doc = \"Reads the whole file again.\"]\n    #[inline]\n    pub fn load(&self) -> u8 {\n    }\n}"),
        ("ruby", "=begin\nReads the whole file again.\n=end\ndef load(a)\nend"), ("c", "/* Reads the whole file again. */\nstatic int load(const char *a)\n{\n}"),
    ]
    for family, text in cases:
        got = one(text, family)
        assert [v[1] for v in got.values()] == [True] and next(iter(got)).lower() == "load", (family, got)


def test_trivial_and_separated():
    assert not one('def load_file():\n    """The load file the file."""\n', "python")["load_file"][1]
    assert not one('def f():\n    """noqa: D103"""\n', "python")["f"][1] and not one('def f():\n    x = """not a docstring at all"""\n', "python")["f"][1]
    assert not one("/** Reads the whole file again. */\n\nint f(int a)\n{\n}", "c")["f"][1]
    assert not one("// eslint-disable-next-line no-unused-vars because of this\nfunction f(a) {\n}", "js")["f"][1]
    assert not one("x(); // Reads the whole file again\nfunction f(a) {\n}", "js")["f"][1]
    assert one('s = """\ndef no(): pass\n"""\ndef f():\n    pass\n', "python").keys() == {"f"}


def test_chunk_before_inheritance_and_dirty_rows(spark):
    base = "class Base:\n    def load(self):\n        '''Reads the whole file again.'''\n    def other(self):\n        pass\n"
    rows = [
        ("p", "a.c", "1", "c", None, "module", 1, 2, "int x;\n/** Writes all rows to disk. */", "o"), ("p", "a.c", "2", "c", None, None, 3, 6, "int save(int a)\n{\n}\n", "o"),
        ("p", "b.py", "3", "python", "Base", None, 1, 5, base, None), ("p", "c.py", "4", "python", None, None, 1, 4, "class Kid(Mid):\n    def load(self):\n        pass\n", None),
        ("p", "d.py", "5", None, None, None, None, None, "class Mid(Base):\n    pass\nclass Loop(Loop2):\n    def load(self): pass\nclass Loop2(Loop):\n    pass\n", None),
        ("p", "e.md", "6", "markdown", None, None, 1, 2, "def f(): pass", None), ("p", "f.py", "7", "python", None, None, 1, 1, None, None), ("p", None, "8", None, None, None, None, None, "", None),
    ]
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    got = sorted((r.chunk_id, r.func_name, r.origin) for r in D.function_docs(df).collect())
    assert got == [("2", "save", "own"), ("3", "load", "own"), ("4", "load", "inherited")]
    assert D.function_docs(df.where("false")).count() == 0


def test_names_that_are_keywords_elsewhere():
    said = "Reads the whole file again."
    cases = [
        ("rust", f"/// {said}\npub fn new(a: u8) -> Self {{\n}}", "new"), ("rust", f"/// {said}\nfn default() -> Self {{\n}}", "default"), ("ruby", f"# {said}\ndef new(a)\nend", "new"),
        *[("python", f"def {n}(a):\n    '''{said}'''\n", n) for n in ("delete", "match", "lock", "default", "switch")], ("go", f"// {said}\nfunc (s *S) delete(a int) {{\n}}", "delete"),
        *[("java", f"class A {{\n    /** {said} */\n    static A {n}(String a) {{\n    }}\n}}", n) for n in ("of", "lock", "delete", "match")], ("java", f"class A {{\n    /** {said} */\n    fun new(a: Int) {{\n    }}\n}}", "new"),
        ("js", f"class A {{\n  /** {said} */\n  delete(id) {{\n  }}\n  /** {said} */\n  catch(f) {{\n  }}\n}}", "catch"), ("js", f"const a = {{\n  /** {said} */\n  with(f) {{\n  }},\n}}", "with"), ("js", f"/** {said} */\nnew(id) {{\n}}", "new"),
        ("cs", f"class A {{\n    /// {said}\n    public int delete(int a) {{\n    }}\n    /// {said}\n    int in_(int a);\n}}", "delete"), ("c", f"/* {said} */\nstruct node *new(int a)\n{{\n}}", "new"), ("c", f"/* {said} */\nvoid foreach(int a) {{\n}}", "foreach"),
    ]
    for family, text, name in cases:
        assert one(text, family).get(name, ("", False))[1], (family, text)
    for family, text in [
        ("js", f"function a() {{\n  // {said}\n  if (b) {{\n  }}\n  switch (c) {{\n  // {said}\n  case (1): {{\n    for (;;) {{\n  }}\n  }}\n  }}\n}}"), ("js", f"class A {{\n  a() {{\n    // {said}\n    while (b) {{\n    }}\n  }}\n}}"),
        ("java", f"class A {{\n  void a() {{\n    // {said}\n    switch (b) {{\n    }}\n  }}\n}}"), ("cs", f"class A {{\n  int a() => b switch {{\n    // {said}\n    Kind when (c) => 1,\n  }};\n}}"),
    ]:
        assert not any(v[1] for v in one(text, family).values()), (family, text)


def test_prose_that_begins_like_a_directive():
    for said in (
        "Global registry of parsers, filled at start-up.", "Region of the file that changed last.", "Pragma lines are kept as they are.", "ESLint reads this list of rules.", "nolint marks are counted by line here.", "rustfmt writes this table of widths.",
        "Indent: how far each line stands in.", "encoding: the name of the character set.", "@deprecated Use the other loader for this.", "@todo Read the rest of it too.", "@internal Called by the planner only once.", "global state of all the open readers", "eslint rules: how each file is read", "@flow of rows between the readers",
    ):
        assert one(f"/** {said} */\nint f(int a)\n{{\n}}", "c")["f"][1], said
    for said in (
        "global alpha, beta: true, gamma, delta", "#region the helpers of this file", "#pragma warning disable one two", "eslint no-unused-vars: 0, eqeqeq: 2, curly: 1", "@param a the first of all values", "NOLINT(readability) the name is given elsewhere",
        "noinspection UnusedOne, UnusedTwo, UnusedThree, UnusedFour", "rubocop:disable Metrics/MethodLength, Metrics/AbcSize", "@ts-ignore the types of this are wrong", "@returns the last of all values", "@internal", "@see Other",
    ):
        assert not one(f"/** {said} */\nint f(int a)\n{{\n}}", "c")["f"][1], said
    assert not one("//region helpers of the whole file\nint f(int a)\n{\n}", "c")["f"][1]


def test_annotations_over_many_lines_and_deep_hierarchies(spark):
    args = "".join(f"    value{i} = (1,\n" for i in range(20)) + "    0" + ")" * 20
    text = f"class A {{\n/** Reads the whole file again. */\n@Config(\n{args}\n)\npublic int load(String a) {{\n}}\n}}"
    assert one(text, "java")["load"][1]
    assert not one(f"/** Reads the whole file again. */\ncall(\n{args}\n)\nint f(int a)\n{{\n}}", "c")["f"][1]
    n = 5
    rows = [("p", f"c{i}.py", f"{i}", "python", None, None, 1, 3, f"class C{i}(C{i - 1}):\n    def load(self):\n        pass\n", None) for i in range(1, n)]
    rows += [("p", "c0.py", "0", "python", None, None, 1, 3, 'class C0:\n    def load(self):\n        """Reads the whole file again."""\n', None)]
    got = {(r.chunk_id, r.origin) for r in D.function_docs(spark.createDataFrame(rows, SCHEMA), with_code=False).collect()}
    assert got == {("0", "own")} | {(f"{i}", "inherited") for i in range(1, n)}


def _found(spark, folder, rows):
    full = [("p", path, str(i), None, symbol, None, 1, text.count("\n") + 1, text, None) for i, path, text, symbol in rows]
    spark.createDataFrame(full, SCHEMA).write.mode("overwrite").parquet(f"{folder}/chunks.parquet")
    return {(r.chunk_id, r.func_name) for r in Q.p4_found(spark, str(folder)).collect()}


def test_found_goes_through_inheritance_in_each_language(spark, tmp_path):
    said = "Reads the whole file again."
    pairs = {
        "py": (f"class Base(Generic[T]):\n    def load(self):\n        '''{said}'''\n", "class Kid(m.Base[int], metaclass=M):\n    def load(self):\n        pass\n"),
        "ts": (f"class Base<T> {{\n  /** {said} */\n  load(a) {{\n  }}\n}}", "class Kid extends Base<Map<string, number>> {\n  load(a) {\n  }\n}"),
        "java": (f"class Base {{\n    /** {said} */\n    public int load(String a) {{\n    }}\n}}", "class Kid extends Base\n{\n    /** {@inheritDoc} */\n    @Override\n    public int load(String a) {\n    }\n}"),
        "cs": (f"class Base\n{{\n    /// <summary>{said}</summary>\n    public virtual int load(int a) {{\n    }}\n}}", "class Kid<T> : Base where T : new()\n{\n    /// <inheritdoc/>\n    public override int load(int a) {\n    }\n}"),
        "rb": (f"class Base\n  # {said}\n  def load(a)\n  end\nend\n", "class Kid < Base\n  def load(a)\n  end\nend\n"),
        "rs": (f"trait Base {{\n    /// {said}\n    fn load(&self) -> u8;\n}}", "impl Base for Kid {\n    fn load(&self) -> u8 {\n    }\n}"),
        "cpp": (f"class Base {{\n    /** {said} */\n    virtual int load(int a) {{\n    }}\n}};", "struct Kid : public ns::Base {\n};\nint Kid::load(int a) {\n}"),
    }
    for ext, (base, kid) in pairs.items():
        rows = [(1, f"a.{ext}", base, None), (2, f"b.{ext}", kid, None), (3, f"c.{ext}", kid.replace("Base", "Other").replace("Kid", "Kid2"), None)]
        assert _found(spark, tmp_path, rows) == {("1", "load"), ("2", "load")}, ext


def test_only_methods_inherit_and_from_the_class_that_is_meant(spark, tmp_path):
    base = "class Base:\n    def load(self):\n        '''Reads the whole file again.'''\n"
    rows = [
        (1, "a.py", base, None),
        (2, "b.py", "class Base:\n    pass\nclass Kid(Base):\n    def load(self):\n        pass\n", None),  # the file has its own Base
        (3, "c.py", "class Kid3(Base):\n    def go(\n        self,\n    ):\n        def load():\n            pass\n", None),
        (4, "d.py", "class Kid4(Base):\n    x = 1\n\ndef go():\n    def load():\n        pass\n", None),
        (5, "e.py", "class Kid5(x, metaclass=Base):\n    def load(self):\n        pass\n", None),
        (6, "f.py", "class Base(a.Base):\n    if x:\n        def load(self):\n            pass\n", None),  # of the same name as its base
        (7, "g.py", "class Kid7(Base):\n    x = 1\n", "Kid7"), (8, "g.py", "    def load(self):\n        pass\n", "Kid7.load"),
        (9, "h.ts", "class Base {\n  /** Reads the whole file again. */\n  load(a) {\n  }\n}\nclass Kid9 extends Base {\n}\nfunction go() {\n  function load(a) {\n  }\n}", None),
    ]
    assert _found(spark, tmp_path, rows) == {(i, "load") for i in "1689"}
