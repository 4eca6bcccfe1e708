"""Small inline tables for rules that the driver's tables don't exercise: the same rows for Spark and for DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


@dataclass(frozen=True)
class Inline:
    """columns: "name type, ..." in Spark's words."""

    columns: str
    rows: list

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    def sql(self) -> str:
        names = [c.split()[0] for c in self.columns.split(", ")]
        kinds = [c.split()[1] for c in self.columns.split(", ")]
        cast = ", ".join(f"CAST({n} AS {SQL_TYPES[k]}) AS {n}" if k in SQL_TYPES else n for n, k in zip(names, kinds, strict=True))
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(SELECT {cast} FROM (VALUES {rows}) AS v({', '.join(names)}))"


MARKDOWN = Inline(
    "slug string, text string",
    [
        ("guide", "lost preface\n# One\nalpha beta gamma delta epsilon zeta eta theta\n## Two\nsome text of the second section, long enough to stay\n### Three\nsome text of the third section, long enough to stay\n```\n# fenced heading that counts as well as any other\n```\n#### Four\nx\n"),
        ("plain", "  no heading at all in this text  \n"),
        ("deep", "### Only\na section of level three without a parent heading before it\n# Top\nthe first heading of level one with enough text behind it"),
    ],
)
VERILOG = Inline(
    "slug string, text string",
    [
        ("alu", "// file comment\n`timescale 1ns/1ps\nmodule alu(input a);\n  // adds\n  assign x = a;\n  always_comb begin\n    y = x; // of some length\n  end\n  initial_x = 3; // starts a block, too\nendmodule\n"),
        ("tiny", "module t;\nendmodule\n"),
        ("notes", "wire a;\n// one\n// two\n// three\n// four\nassign b = a + 1;\n"),
    ],
)
ASM = Inline(
    "slug string, path string, text string",
    [
        ("add", "/isa/rv32ui/add.S", "#include \"../rv64ui/add.S\"\n"),
        ("add64", "/isa/rv64ui/add.S", "RVTEST_START\n" + "\n" * 10 + "TEST_RR_OP( 2,  add, 0x00000000, 0x1, , 0x2 );\nTEST_IMM_OP(3, addi, 5, (1+1), 2);\nTEST_ZERO( 4 , x.y , 7)\n"),
        ("lone", "/isa/rv32ui/lone.S", "#include \"x.h\"\n"),
    ],
)
SPANS = Inline(
    "doc string, seq int, text string, size double, page int",
    [
        ("m", 1, "front matter that is long enough to be kept as the introduction of it all", 10.0, 1),
        ("m", 2, "Lost Title", 14.0, 1),
        ("m", 3, "Real Title", 14.0, 2),
        ("m", 4, "body text of the first real section,", 10.0, 2),
        ("m", 5, "which goes on for quite a while so that it is kept", 10.0, 2),
        ("m", 6, "Short", 12.0, 3),
        ("m", 7, "too short", 10.0, 3),
        ("m", 8, "Last", 11.0, 4),
        ("m", 9, "closing section with a good many words so that it passes the limit as well", 10.0, 4),
        ("m", 10, " ", 30.0, 4),
    ],
)
VIEWS = Inline(
    "slug string, text string",
    [
        ("guide", "dropped\n<!-- chunk_id=guide_0 | One -->\n\nfirst paragraph of the view, long enough to be kept as a child\n\nshort\n\n**second** paragraph of the view with [a link](u) and long enough to stay\n<!-- guide_1 -->\n\nthe third paragraph belongs to another divider without any title"),
        ("empty", "<!-- chunk_id=empty_0 | None -->\nshort"),
    ],
)
PARENTS = Inline(
    "slug string, chunk_id string, section_title string, document_text string",
    [
        ("guide", "guide_0", "One", "text of one"),
        ("guide", "guide_1", "Second title", "text of two"),
        ("empty", "empty_0", "None", "This is a fallback sentence of some length. Another sentence follows it here, of some length. Tiny. And a last one that is also long enough."),
        ("bare", "bare_0", "Bare", "A source without any view is packed by sentences. It has two of them, both long enough."),
        ("bare", "", "No id", "left out"),
    ],
)
PARAGRAPHS = Inline(
    "id int, text string",
    [
        (1, "see `[FIGURE: a chart]` and ![alt](img.png) then [link](http://x) and **bold** *it*"),
        (2, "before\n```c\nint x;\n```\nafter the fence"),
        (3, "| a | b |\n|---|---|\ntext after table"),
        (4, "> quoted sidebar\nbody   text\twith   blanks"),
        (5, "## Heading mark\nand words"),
        (6, "plain"),
        (7, ""),
    ],
)
CITED = Inline("id int, text string", [(1, "as in [11](http://a/b) and [[12](u)]"), (2, "no citation [x](y)"), (3, "[7]() [8](z)")])
SALVAGE = Inline(
    "id int, text string",
    [(1, '{"a": 1}'), (2, 'Sure! {"a": 2} done'), (3, "```json\n{\"a\": 3}\n```"), (4, 'list [1, 2] end'), (5, '{"a": 4'), (6, "none"), (7, 'x [{"a": 5}] y')],
)
URLS = Inline(
    "id int, url string",
    [
        (1, "https://github.com/u/r/tree/main/src/rtl"),
        (2, "https://github.com/u/r/blob/main/src/alu.v"),
        (3, "https://api.github.com/repos/u/r/contents/src?ref=main"),
        (4, "https://raw.githubusercontent.com/u/r/main/add.S"),
        (5, "https://x.org/docs/README.md"),
        (6, "https://x.org/spec.PDF"),
        (7, "https://x.org/a/b.html?x=1"),
        (8, "https://x.org/logo.svg"),
        (9, "https://x.org/"),
        (10, "https://github.com/u/r"),
        (11, "https://x.org/very%20long/na%me with space.md"),
        (12, "https://github.com/u/r/tree/dev"),
        (13, "https://x.org/.gitignore"),
    ],
)
LINES = Inline(
    "seq int, line string",
    [(1, "PASS:add"), (2, "FAIL:sub:3"), (3, "TIMEOUT:loop"), (4, "UNKNOWN:odd"), (5, " PASS:xor "), (6, "DONE"), (7, ""), (8, "FAIL:sll:12:x")],
)
ERRORS = Inline(
    "id int, status int, message string",
    [(1, 413, "too large"), (2, 429, "tokens per minute (TPM)"), (3, 429, "tokens per day (TPD)"), (4, 429, "?"), (5, 500, "server"), (6, None, "insufficient_quota"), (7, None, "Rate limit: daily limit, rpm"), (8, None, "refused")],
)
DURATIONS = Inline("id int, text string", [(1, "2m59.5s"), (2, "7.66s"), (3, "0s"), (4, "garbage"), (5, "10m0s"), (6, "3m")])
CODE = Inline(
    "module string, code string",
    [
        ("good", "module good;\n  logic used;\n  logic [3:0] idle; // idle idle\n  assign y = used;\nendmodule\n"),
        ("ram", "module ram;\n  logic [31:0] mem [0:1023];\n  reg [7:0] m2 [0:3];\n  always_ff @(posedge clk) begin\n    if (STALL) begin x <= 1; end\nendmodule"),
        ("cut", "module cut;\n  wire w;\n  case (x)\n  // begin end\n  1: begin"),
        ("pipe", "```verilog\nmodule pipe;\n  reg ID_EX;\nendmodule\n```"),
    ],
)
TABLES = Inline(
    "id int, rows array<array<string>>",
    [
        (1, [["31", "30:25", "0"], ["w", "w", "w"], ["imm", "", "op"], ["1", "6", "7"], ["sign", "x", "code"]]),
        (2, [["a", "b|c"], ["", "d"]]),
        (3, [["", "note one"], [" ", "note two"]]),
        (4, [["x%d" % i, "", ""] for i in range(10)]),
        (5, [["h"], ["7", "y"], ["", ""]]),
    ],
)
FILES = Inline("file string, text string", [("ctrl", "module control; always_comb default: begin end"), ("imm", "module imm_gen; instr[31:20]")])
CHECKS = Inline("name string, file string, needle string", [("control", "ctrl", "module control"), ("comb", "ctrl", "always_comb"), ("imm", "imm", "instr[31:20]"), ("jump", "imm", "instr[19:12]"), ("gone", "none", "x")])
PATHS = Inline("path string", [("r/test_v2.json",), ("r/test_v10.json",), ("r/test.json",), ("r/test_v9.json",)])
EDGES = Inline("src string, dst string", [("cpu", "control"), ("cpu", "alu"), ("control", "imm_gen"), ("tb", "cpu"), ("alu", "imm_gen")])
TRACE = Inline("seq int, value bigint", [(0, 0), (1, 4), (2, 4), (3, 4), (4, 8), (5, 4), (6, None), (7, None)])
MODULES = Inline("id int, name string", [(1, "control"), (2, "alu"), (3, "tb_cpu"), (4, "imm_gen")])
NOW = Inline("slug string, file_hash string", [("a", "1"), ("b", "2"), ("c", "3")])
MANIFEST = Inline("slug string, file_hash string", [("a", "1"), ("b", "9"), ("d", "4")])
VOCAB = Inline(
    "kind string, pos int, item string",
    [(k, i, x) for k, xs in (
        ("alu", "ADD SUB AND OR XOR SLL SRL SRA SLT SLTU"), ("mem_size", "BYTE HALF WORD"), ("imm_type", "I S B U J"), ("writeback", "ALU MEMORY PC_PLUS_4 IMMEDIATE"), ("branch", "EQ NE LT GE LTU GEU"),
    ) for i, x in enumerate(xs.split())],
)
#: Fixed values of the RV32I base: format, opcode, then mnemonic:funct3:funct7b5.
BASE = """
R 0110011 ADD:000:0 SUB:000:1 SLL:001:0 SLT:010:0 SLTU:011:0 XOR:100:0 SRL:101:0 SRA:101:1 OR:110:0 AND:111:0
I 0010011 ADDI:000 SLTI:010 SLTIU:011 XORI:100 ORI:110 ANDI:111 SLLI:001:0 SRLI:101:0 SRAI:101:1
U 0110111 LUI
U 0010111 AUIPC
J 1101111 JAL
I 1100111 JALR:000
B 1100011 BEQ:000 BNE:001 BLT:100 BGE:101 BLTU:110 BGEU:111
I 0000011 LB:000 LH:001 LW:010 LBU:100 LHU:101
S 0100011 SB:000 SH:001 SW:010
"""


def _base() -> tuple[list, list]:
    instructions, behaviour = [], []
    for form, opcode, *names in map(str.split, BASE.strip().splitlines()):
        for name in names:
            m, f3, f7 = (name.split(":") + [None, None])[:3]
            n = len(instructions)
            instructions.append((n, m, form, opcode, f3, None if f7 is None else int(f7)))
            load, arith, jump = opcode == "0000011", opcode in ("0110011", "0010011"), opcode in ("1101111", "1100111")
            size = {"B": "BYTE", "H": "HALF", "W": "WORD"}[m[1]] if load or form == "S" else None
            op = {"SLTIU": "SLTU"}.get(m, m[:-1] if form == "I" and arith else m) if arith else "ADD"
            a = "zero" if m == "LUI" else "pc" if m in ("AUIPC", "JAL") else "rs1"
            back = "MEMORY" if load else "PC_PLUS_4" if jump else "IMMEDIATE" if m == "LUI" else "ALU"
            extend = ("unsigned" if m.endswith("U") else "none" if m == "LW" else "signed") if load else None
            behaviour.append((n, m.lower(), op, a, "rs2" if form in "RB" else "imm", back, form not in "SB", load, form == "S", size, extend, form == "B", jump, m.lower() if jump else None))
    return instructions, behaviour


INSTRUCTIONS = Inline("ord int, mnemonic string, format string, opcode string, funct3 string, funct7b5 int", _base()[0])
BEHAVIOUR = Inline(
    "ord int, mnemonic string, alu_op string, alu_src_a string, alu_src_b string, writeback string, reg_write boolean, mem_read boolean, mem_write boolean, mem_size string, mem_extend string, branch boolean, jump boolean, jump_type string",
    _base()[1],
)
