"""Queries on contract tables and bit functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import bits as B
from quern.operators import contract as K
from quern.plans import fixtures as X
from quern.plans import given as G


def _enc(s):
    return K.encode_vocabulary(X.VOCAB.df(s))


def _table(s):
    return K.control_table(X.INSTRUCTIONS.df(s), X.BEHAVIOUR.df(s), _enc(s))


def _legend(s):
    return K.branch_legend(X.VOCAB.df(s), X.INSTRUCTIONS.df(s))


def words(spark, sf_dir):
    """32-bit words from lineitem keys."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = B.word(F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503)
    return li.select(F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("int").alias("line"), w.alias("word"))


def pairs(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.select("k", "line", F.col("word").alias("a"), B.word(F.col("word") * 69069 + 12345).alias("b"))


OPS = "ADD SUB AND OR XOR SLL SRL SRA SLT SLTU".split()
F3 = "000 001 100 101 110 111".split()
CASES = X.Inline(
    "id int, macro string, expected string, rs1 string, rs2 string, op string",
    [
        (1, "TEST_RR_OP", "0x0000000000000003", "0x1", "0x2", "ADD"), (2, "TEST_RR_OP", "0xffffffffffff8000", "0x0000000000000000", "0xffffffffffff8000", "ADD"), (3, "TEST_RR_OP", "0xffffffff80000000", "0xffffffff80000000", "0", "SUB"),
        (4, "TEST_RR_OP", "0x1", "-1", "1", "SLT"), (5, "TEST_RR_OP", "0x0", "-1", "1", "SLTU"), (6, "TEST_RR_OP", "0xffffffffffffffff", "0xffffffff80000000", "31", "SRA"), (7, "TEST_RR_OP", "0x2", "0x1", "33", "SLL"), (8, "TEST_RR_OP", "0x5", "0x1", "0x2", "ADD"),
    ],
)


def alu_vectors(spark, sf_dir):
    c = CASES.df(spark)
    got = B.alu(F.col("op"), B.hex_word(F.col("rs1")), B.hex_word(F.col("rs2")))
    return c.select("id", got.alias("computed"), (got == B.hex_word(F.col("expected"))).alias("passed"))


def lane_rows(spark, sf_dir):
    w = pairs(spark, sf_dir).withColumns({"size": F.pmod("k", F.lit(3)).cast("int"), "unsigned": F.col("line") % 2 == 0})
    x = B.lanes(F.col("a"), F.col("size"), F.col("b"), F.col("unsigned"))
    return w.select("k", "line", *(c.alias(n) for n, c in x.items()))


_more = ", ".join(f"{c} string" for c in ("imm_type", "alu_src_a", "alu_src_b", "result_src", "mem_size", "mem_extend", "branch_type", "jump_type"))
LEGACY = X.Inline(
    f"ord int, instruction string, opcode string, funct3 string, funct7 string, alu_op string, reg_write boolean, mem_read boolean, mem_write boolean, branch boolean, jump boolean, {_more}",
    [
        (0, "SUB", "0110011", "000", "0100000", "SUB", True, False, False, False, False, None, "rs1", "rs2", "alu", None, None, None, None),
        (1, "ADD", "0110011", "000", "0000000", None, True, None, False, False, False, "N/A", "rs1", "rs2", "alu", "N/A", "N/A", "N/A", "N/A"),
        (2, None, "x", "x", "x", "x", True, True, True, True, True, "x", "x", "x", "x", "x", "x", "x", "x"),
        (3, "JAL", "1101111", "N/A", None, "MUL", True, False, False, False, True, "J", "pc", "imm", "pc4", None, None, None, "jal"),
        (4, "LBU", "0000011", "100", "N/A", "ADD", True, True, False, False, False, "I", "rs1", "imm", "mem", "byte", "unsigned", None, None),
    ],
)

QUERIES = {
    "legacy_cheatsheet": lambda s, d: K.legacy_lines(LEGACY.df(s)),
    "legacy_sheet": lambda s, d: K.legacy_sheet(LEGACY.df(s)),
    "cheatsheet_text": lambda s, d: K.cheatsheet(_table(s), _enc(s)),
    "cheatsheet_legends": lambda s, d: K.cheatsheet(_table(s), _enc(s), _legend(s)),
    "immediate_text": lambda s, d: K.immediate_module(_enc(s)),
    "table_modules": lambda s, d: K.table_modules(_table(s), _enc(s)).select("module", F.md5("text").alias("text_md5")),
    "plan_edges": lambda s, d: K.plan_edges(G.PLANS.df(s, d)),
    "all_questions": lambda s, d: K.all_questions(G.BASE_QUESTIONS.df(s, d), G.DYNAMIC.df(s, d)),
    "vocab_encoding": lambda s, d: _enc(s),
    "vocab_check": lambda s, d: K.check_vocabulary(X.VOCAB.df(s).filter("kind <> 'branch' AND pos < 3 AND kind <> 'alu'")),
    "branch_encoding": lambda s, d: K.encode_branches(X.VOCAB.df(s).union(s.createDataFrame([("branch", 6, "odd")], "kind string, pos int, item string")), X.INSTRUCTIONS.df(s)),
    "icd_build": lambda s, d: K.checked(_table(s)),
    "icd_collisions": lambda s, d: K.collisions(_table(s).withColumn("funct7b5", F.lit(None).cast("int"))),
    "control_groups": lambda s, d: K.control_groups(_table(s)),
    "cheatsheet": lambda s, d: K.cheatsheet_lines(_table(s), _enc(s)),
    "control_arms": lambda s, d: K.control_arms(_table(s), _enc(s)),
    "control_text": lambda s, d: K.control_module(_table(s), _enc(s)),
    "immediate_arms": lambda s, d: K.immediate_arms(_enc(s)),
    "module_tiers": lambda s, d: G.MODULES.df(s, d).select("id", "name", K.module_tier(F.col("name")).alias("tier")),
    "microarch_document": lambda s, d: K.microarch(_table(s), _enc(s), "RV32I"),
    "microarch_rows": lambda s, d: K.read_microarch(K.microarch(_table(s), _enc(s), "RV32I"), _table(s)),
    "module_prompt": lambda s, d: K.module_prompt("alu", _table(s), _enc(s), _legend(s)),
    "top_module_prompt": lambda s, d: K.module_prompt("cpu", _table(s), _enc(s), _legend(s)),
    "imm_decode": lambda s, d: words(s, d).select("k", "line", *(B.immediate(F.col("word"), f).alias(f"imm_{f.lower()}") for f in "ISBUJ")),
    "word_decode": lambda s, d: K.decode(words(s, d).select("k", "line", F.col("word").bitwiseAND(F.lit(0xFFFFFF80)).bitwiseOR(F.when(F.col("line") % 2 == 0, F.lit(0x33)).otherwise(F.lit(0x63))).alias("word")), _table(s)),
    "alu_eval": lambda s, d: pairs(s, d).select("k", "line", *(B.alu(F.lit(o), F.col("a"), F.col("b")).alias(f"r_{o.lower()}") for o in OPS)),
    "alu_vectors": alu_vectors,
    "branch_eval": lambda s, d: pairs(s, d).select("k", "line", *(B.branch_taken(F.lit(f), F.col("a"), F.col("b")).alias(f"t_{f}") for f in F3)),
    "lane_mask": lane_rows,
    "next_pc": lambda s, d: pairs(s, d).select("k", "line", B.next_pc(F.col("a"), F.col("b"), F.col("a"), F.col("line") % 3 == 0, F.col("line") % 3 == 1, F.col("line") % 2 == 1).alias("pc")),
}

ENC = f"""n AS (SELECT kind, count(*) AS n FROM {X.VOCAB.sql()} GROUP BY kind), it AS (SELECT kind, item, min(pos) AS pos FROM {X.VOCAB.sql()} GROUP BY kind, item),
    en AS (SELECT it.kind, item, CAST(row_number() OVER (PARTITION BY it.kind ORDER BY pos) - 1 AS INTEGER) AS code,
           CASE WHEN it.kind = 'branch' THEN 3 ELSE greatest(1, CAST(ceil(log2(greatest(n + CASE WHEN it.kind = 'imm_type' THEN 1 ELSE 0 END, 2))) AS INTEGER)) END AS width FROM it JOIN n ON it.kind = n.kind),
    enc AS (SELECT *, right(lpad(bin(code), 8, '0'), width) AS "binary" FROM en)"""
TABLE = f"""{ENC}, bl AS (SELECT * FROM {X.BEHAVIOUR.sql()} QUALIFY row_number() OVER (PARTITION BY upper(mnemonic) ORDER BY ord DESC) = 1),
    icd AS (SELECT i.ord, upper(i.mnemonic) AS mnemonic, i.format, i.opcode, i.funct3, i.funct7b5, coalesce(a.code, 0) AS alu_op, m.code AS imm_type, coalesce(w.code, 0) AS writeback, z.code AS mem_size, coalesce(alu_src_a, 'rs1') AS alu_src_a, coalesce(alu_src_b, 'rs2') AS alu_src_b,
            CAST(reg_write AS INTEGER) AS reg_write, CAST(mem_read AS INTEGER) AS mem_read, CAST(mem_write AS INTEGER) AS mem_write, CAST(branch AS INTEGER) AS branch, CAST(jump AS INTEGER) AS jump, mem_extend, jump_type
        FROM {X.INSTRUCTIONS.sql()} i JOIN bl ON upper(i.mnemonic) = upper(bl.mnemonic) LEFT JOIN enc a ON a.kind = 'alu' AND a.item = coalesce(bl.alu_op, 'ADD') LEFT JOIN enc w ON w.kind = 'writeback' AND w.item = coalesce(bl.writeback, 'ALU')
        LEFT JOIN enc m ON m.kind = 'imm_type' AND m.item = i.format LEFT JOIN enc z ON z.kind = 'mem_size' AND z.item = bl.mem_size)"""
BIN = "lpad(bin({c}), {w}, '0')"
ARMS = f"""{TABLE}, x AS (SELECT *, coalesce(funct3, '000') AS f3, count(*) OVER (PARTITION BY opcode) AS n_op, count(*) OVER (PARTITION BY opcode, coalesce(funct3, '000')) AS n_f3 FROM icd),
    y AS (SELECT *, n_op > 1 AND n_f3 > 1 AS split FROM x),
    arms AS (SELECT opcode, CASE WHEN n_op > 1 THEN f3 END AS funct3, CASE WHEN split THEN funct7b5 END AS funct7b5, ord, mnemonic,
        concat_ws(' ', 'alu_op = 4''b' || {BIN.format(c='alu_op', w=4)} || ';', 'alu_src_b = 1''b' || CASE WHEN alu_src_b = 'imm' THEN '1' ELSE '0' END || ';', CASE WHEN NOT split THEN 'alu_src_a = 2''b' || CASE alu_src_a WHEN 'pc' THEN '01' WHEN 'zero' THEN '10' ELSE '00' END || ';' END,
        'result_src = 2''b' || {BIN.format(c='writeback', w=2)} || ';', 'reg_write = 1''b' || reg_write || ';', CASE WHEN NOT split THEN 'mem_read = 1''b' || mem_read || '; mem_write = 1''b' || mem_write || ';' END,
        CASE WHEN NOT split AND mem_size IS NOT NULL THEN 'mem_size = 2''b' || {BIN.format(c='mem_size', w=2)} || '; mem_extend = 1''b' || CASE WHEN mem_extend = 'unsigned' THEN '1' ELSE '0' END || ';' END,
        CASE WHEN NOT split THEN 'branch = 1''b' || branch || ';' END, CASE WHEN NOT split AND branch = 1 AND n_op > 1 THEN 'branch_type = 3''b' || f3 || ';' END, CASE WHEN NOT split THEN 'jump = 1''b' || jump || ';' END,
        CASE WHEN NOT split AND jump = 1 THEN 'jump_type = 1''b' || CASE WHEN jump_type = 'jalr' THEN '1' ELSE '0' END || ';' END, CASE WHEN imm_type IS NOT NULL THEN 'imm_type = 3''b' || {BIN.format(c='imm_type', w=3)} || ';' END) AS body FROM y)"""
SHEET = f"""sheet AS (SELECT ord, printf('%-8s| %-7s | %-3s | %-4s | 4''b%s| 3''b%s| 2''b%s| %d  | %d  | %d  | %d  | %d   | %-6s | %-5s | 2''b%s', mnemonic, opcode, coalesce(funct3, '---'), coalesce(CAST(funct7b5 AS VARCHAR), '-'), {BIN.format(c='alu_op', w=4)},
    coalesce({BIN.format(c='imm_type', w=3)}, 'N/A'), {BIN.format(c='writeback', w=2)}, reg_write, mem_read, mem_write, branch, jump, alu_src_a, alu_src_b, coalesce({BIN.format(c='mem_size', w=2)}, 'N/A')) AS line FROM icd)"""
WORD = "((l_orderkey::HUGEINT * 2654435761 + l_linenumber * 40503) % 4294967296)::BIGINT"
W = f"w AS (SELECT l_orderkey::BIGINT AS k, l_linenumber::INTEGER AS line, {WORD} AS word FROM lineitem)"
AB = f"{W}, ab AS (SELECT k, line, word AS a, ((word::HUGEINT * 69069 + 12345) % 4294967296)::BIGINT AS b FROM w)"
M = "4294967295"


def sg(x: str) -> str:
    return f"({x} - CASE WHEN {x} >= 2147483648 THEN 4294967296 ELSE 0 END)"


def bit(high: int, low: int, w: str = "word") -> str:
    return f"(({w} >> {low}) & {(1 << (high - low + 1)) - 1})"


def ext(x: str, n: int) -> str:
    return f"((xor({x}, {1 << (n - 1)}) - {1 << (n - 1)}) & {M})"


_imm = {
    "i": ext(bit(31, 20), 12), "s": ext(f"(({bit(31, 25)} << 5) + {bit(11, 7)})", 12), "b": ext(f"(({bit(31, 31)} << 12) + ({bit(7, 7)} << 11) + ({bit(30, 25)} << 5) + ({bit(11, 8)} << 1))", 13),
    "u": f"({bit(31, 12)} << 12)", "j": ext(f"(({bit(31, 31)} << 20) + ({bit(19, 12)} << 12) + ({bit(20, 20)} << 11) + ({bit(30, 21)} << 1))", 21),
}
_alu = {
    "ADD": f"((a + b) & {M})", "SUB": f"((a - b + 4294967296) & {M})", "AND": "(a & b)", "OR": "(a | b)", "XOR": "xor(a, b)", "SLL": f"((a::HUGEINT * (1::HUGEINT << (b & 31)::INTEGER)) % 4294967296)::BIGINT", "SRL": "(a >> (b & 31))",
    "SRA": f"((({sg('a')} >> (b & 31)) + 4294967296) & {M})", "SLT": f"CAST({sg('a')} < {sg('b')} AS BIGINT)", "SLTU": "CAST(a < b AS BIGINT)",
}
_case = f"CASE op {' '.join(f'WHEN {chr(39)}{o}{chr(39)} THEN {e}' for o, e in _alu.items())} END"
_taken = {"000": "a = b", "001": "a <> b", "100": f"{sg('a')} < {sg('b')}", "101": f"{sg('a')} >= {sg('b')}", "110": "a < b", "111": "a >= b"}
_hexw = lambda c: f"(CASE WHEN starts_with({c}, '0x') THEN CAST('0x' || right(substr({c}, 3), 8) AS BIGINT) ELSE (CAST({c} AS BIGINT) + 4294967296) % 4294967296 END)"

#: The modules' heads with the widths of the fixture, and the sheets' heads, spelled out.
CONTROL_HEAD = """module control (
    input logic [6:0] opcode,
    input logic [2:0] funct3,
    input logic funct7b5,
    output logic [3:0] alu_op,
    output logic alu_src_b,
    output logic [1:0] alu_src_a,
    output logic [1:0] result_src,
    output logic reg_write,
    output logic mem_read,
    output logic mem_write,
    output logic [1:0] mem_size,
    output logic mem_extend,
    output logic branch,
    output logic [2:0] branch_type,
    output logic jump,
    output logic jump_type,
    output logic [2:0] imm_type
);
always_comb begin
alu_op = 4'b0;
alu_src_b = 1'b0;
alu_src_a = 2'b0;
result_src = 2'b0;
reg_write = 1'b0;
mem_read = 1'b0;
mem_write = 1'b0;
mem_size = 2'b0;
mem_extend = 1'b0;
branch = 1'b0;
branch_type = 3'b0;
jump = 1'b0;
jump_type = 1'b0;
imm_type = 3'b0;
case (opcode)"""
IMMEDIATE_HEAD = """module imm_gen (
    input logic [31:0] instr,
    input logic [2:0] imm_type,
    output logic [31:0] imm
);
always_comb begin
case (imm_type)"""
SHEET_HEAD = "=== MICROARCH WIRING CHEATSHEET (use ONLY these values) ===\nINSTR   | opcode  | f3  | f7b5 |    alu_op|    imm|    wb| rw | mr | mw | br | jmp | alu_a  | alu_b | mem_sz\n"
LEGACY_HEAD = "=== ISA WIRING CHEATSHEET (binary constants only — use these EXACTLY) ===\nINSTR | opcode  | f3  | f7b5 | alu_op  | imm   | rw | mr | mw | br | jmp | alu_a | alu_b | res_src| m_sz | m_ext| br_type| jmp_t\n" + "-" * 125 + "\n"
_legends = """(SELECT chr(10) || chr(10) || '=== ALU_OP ENCODING (canonical — alu.v and control.v MUST match) ===' || chr(10) || (SELECT string_agg('  4''b' || "binary" || ' = ' || item, chr(10) ORDER BY code) FROM enc WHERE kind = 'alu')
    || chr(10) || chr(10) || '=== IMM_TYPE ENCODING (canonical — imm_gen.v and control.v MUST match) ===' || chr(10) || (SELECT string_agg('  3''b' || "binary" || ' = ' || item || '-type', chr(10) ORDER BY code) FROM enc WHERE kind = 'imm_type')
    || chr(10) || chr(10) || '=== BRANCH funct3 ENCODING (canonical — branch_unit.v MUST use these) ===' || chr(10) || (SELECT string_agg('  3''b' || funct3 || ' = ' || item, chr(10) ORDER BY pos) FROM """ + X.VOCAB.sql() + """ v JOIN """ + X.INSTRUCTIONS.sql() + """ i ON i.mnemonic = 'B' || upper(item) WHERE kind = 'branch'))"""
_lines = "(SELECT string_agg(line, chr(10) ORDER BY ord) FROM sheet)"
_task = "Write the module {m}.\nArchitecture: RV32I, XLEN 32, single-cycle, no pipeline registers.\nReset PC: 0x00000000. x0 is zero; JALR clears the lowest bit.\nUse these encodings and no others.\n\n"
_text = ("mnemonic", "format", "opcode", "funct3", "alu_src_a", "alu_src_b", "mem_extend", "jump_type")
_columns = "ord mnemonic format opcode funct3 funct7b5 alu_op imm_type writeback mem_size alu_src_a alu_src_b reg_write mem_read mem_write branch jump mem_extend jump_type".split()
#: Members that are null are left out of the JSON, and of concat_ws.
_members = ", ".join(f"""'"{c}":"' || {c} || '"'""" if c in _text else f"""'"{c}":' || {c}""" for c in _columns)
_end = "\n\nAnswer with the module {m} alone, without a test bench."
OTHER_HEADS = {
    "regfile": "input logic clk|input logic we|input logic [4:0] rs1|input logic [4:0] rs2|input logic [4:0] rd|input logic [31:0] rd_data|output logic [31:0] rd1|output logic [31:0] rd2",
    "imm_gen": "input logic [31:0] instr|input logic [2:0] imm_type|output logic [31:0] imm",
    "control": "|".join(x.strip().rstrip(",") for x in CONTROL_HEAD.split(");")[0].split("\n")[1:-1]),
    "alu": "input logic [31:0] a|input logic [31:0] b|input logic [3:0] alu_op|output logic [31:0] result|output logic zero",
    "branch_unit": "input logic [2:0] branch_type|input logic [31:0] rs1|input logic [31:0] rs2|input logic branch|output logic taken",
    "load_store": "input logic mem_read|input logic mem_write|input logic [1:0] mem_size|input logic mem_extend|input logic [31:0] addr|input logic [31:0] wdata|input logic [31:0] mem_rdata|output logic [31:0] rdata|output logic [31:0] mem_addr|output logic [31:0] mem_wdata|output logic [3:0] mem_wstrb",
    "pc_next": "input logic [31:0] pc|input logic [31:0] imm|input logic [31:0] rs1|input logic taken|input logic jump|input logic jump_type|output logic [31:0] next_pc",
}
_heads = "\n\nInstantiate these modules in this order and connect ports by name:" + "".join(f"\n\nmodule {m} (\n" + ",\n".join(f"    {x}" for x in p.split("|")) + "\n);" for m, p in OTHER_HEADS.items())

_control = """WITH f AS (SELECT opcode, funct3, min(ord) AS fo, string_agg(CASE WHEN funct7b5 IS NOT NULL THEN 'if (funct7b5 == 1''b' || funct7b5 || ') begin ' || body || ' end' ELSE body END, chr(10) ORDER BY ord) AS line FROM arms GROUP BY opcode, funct3),
        o AS (SELECT opcode, min(fo) AS oo, max(funct3) AS any3, string_agg(CASE WHEN funct3 IS NULL THEN line ELSE '3''b' || funct3 || ': begin ' || line || ' end' END, chr(10) ORDER BY fo) AS line FROM f GROUP BY opcode)
        SELECT """ + X.literal(CONTROL_HEAD) + """ || chr(10) || string_agg('7''b' || opcode || ': begin' || chr(10) || CASE WHEN any3 IS NULL THEN line ELSE 'case (funct3)' || chr(10) || line || chr(10) || 'default: begin end' || chr(10) || 'endcase' END || chr(10) || 'end', chr(10) ORDER BY oo)
               || chr(10) || 'default: begin end' || chr(10) || 'endcase' || chr(10) || 'end' || chr(10) || 'endmodule' AS text FROM o"""
_bits = ", ".join("('" + f + "', '" + b.replace("'", "''") + "')" for f, b in K.IMMEDIATE_BITS.items())
_ops = ", ".join(f"('{o}', '4''b{i:04b}')" for i, o in enumerate(K.LEGACY_OPS))
_imm_text = """SELECT """ + X.literal(IMMEDIATE_HEAD) + """ || chr(10)
    || string_agg(length("binary") || '''b' || "binary" || ': imm = {' || CASE WHEN sb > 0 THEN '{' || sb || '{instr[31]}}, ' ELSE '' END || bits || '};', chr(10) ORDER BY code) || chr(10) || 'default: imm = 32''b0;' || chr(10) || 'endcase' || chr(10) || 'end' || chr(10) || 'endmodule' AS text
    FROM (SELECT code, "binary", bits, CASE f WHEN 'I' THEN 20 WHEN 'S' THEN 20 WHEN 'B' THEN 19 WHEN 'U' THEN 0 WHEN 'J' THEN 11 END AS sb FROM enc JOIN (VALUES """ + _bits + """) v(f, bits) ON item = f WHERE kind = 'imm_type')"""
_nn = lambda c: f"coalesce({c}, 'N/A')"
_old = f"""old AS (SELECT ord, printf('%-6s| %-7s | %-3s | %-4s | %-8s| %-6s| %d  | %d  | %d  | %d  | %d   | %-6s| %-5s | %-7s| %-5s| %-5s| %-7s| %s', instruction, opcode, CASE WHEN funct3 = 'N/A' THEN '---' ELSE funct3 END,
    CASE WHEN coalesce(funct7, 'N/A') = 'N/A' THEN '-' WHEN funct7 = '0100000' THEN '1' ELSE '0' END, coalesce(c, alu_op, 'ADD'), {_nn('imm_type')}, coalesce(reg_write::INT, 0), coalesce(mem_read::INT, 0), coalesce(mem_write::INT, 0), coalesce(branch::INT, 0), coalesce(jump::INT, 0),
    {', '.join(_nn(c) for c in ('alu_src_a', 'alu_src_b', 'result_src', 'mem_size', 'mem_extend', 'branch_type', 'jump_type'))}) AS line FROM {LEGACY.sql()} LEFT JOIN (VALUES {_ops}) v(o, c) ON coalesce(alu_op, 'ADD') = o WHERE instruction IS NOT NULL)"""

SQL = {
    "legacy_cheatsheet": f"WITH {_old} SELECT * FROM old",
    "legacy_sheet": f"WITH {_old} SELECT {X.literal(LEGACY_HEAD)} || string_agg(line, chr(10) ORDER BY ord) AS text FROM old",
    "cheatsheet_text": f"WITH {TABLE}, {SHEET} SELECT {X.literal(SHEET_HEAD + '-' * 110)} || chr(10) || {_lines} AS text",
    "cheatsheet_legends": f"WITH {TABLE}, {SHEET} SELECT {X.literal(SHEET_HEAD + '-' * 112)} || chr(10) || {_lines} || {_legends} AS text",
    "microarch_document": f"""WITH {TABLE}, w AS (SELECT '[' || string_agg('{{' || concat_ws(',', {_members}) || '}}', ',' ORDER BY ord) || ']' AS rows FROM icd),
        k AS (SELECT kind, '{{"kind":"' || kind || '","width":' || max(width) || ',"encoding":[' || string_agg('{{"code":' || code || ',"item":"' || item || '","binary":"' || "binary" || '"}}', ',' ORDER BY code) || ']}}' AS v FROM enc GROUP BY kind)
        SELECT '{{"architecture":"RV32I","xlen":32,"vocabularies":[' || (SELECT string_agg(v, ',' ORDER BY kind) FROM k) || '],"instruction_icd":' || rows || '}}' AS document FROM w""",
    "microarch_rows": f"WITH {TABLE} SELECT * FROM icd",
    "immediate_text": f"WITH {ENC} {_imm_text}",
    "table_modules": f"WITH {ARMS}, ct AS ({_control}), im AS ({_imm_text}) SELECT 'control' AS module, md5(text) AS text_md5 FROM ct UNION ALL SELECT 'imm_gen', md5(text) FROM im",
    "plan_edges": f"""WITH m AS (SELECT plan, json_extract(CASE WHEN json_valid(document) THEN document END, '$.modules[*]') AS ms FROM {G.PLANS.sql()}), x AS (SELECT plan, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS place FROM m),
        y AS (SELECT plan, CAST(place AS INTEGER) AS place, json_extract_string(m, '$.name') AS module, json_extract_string(m, '$.depends_on[*]') AS ds FROM x)
        SELECT plan, place, module, unnest(CASE WHEN len(ds) > 0 THEN ds ELSE [NULL] END) AS depends_on FROM y""",
    "all_questions": f"SELECT key, question FROM {G.BASE_QUESTIONS.sql()} UNION ALL SELECT 'dynamic_query_' || (pos + 1), question FROM {G.DYNAMIC.sql()}",
    "vocab_encoding": f"WITH {ENC} SELECT * FROM enc",
    "vocab_check": """SELECT * FROM (VALUES ('alu', 'Missing ''alu_operations''. The Stage 1 LLM may have rate-limited or hallucinated invalid JSON.'), ('branch', 'Missing ''branch_conditions'' from Stage 1 facts. Ensure Stage 1 succeeded.')) v(kind, error)""",
    "branch_encoding": f"""SELECT item, CAST(coalesce(f, pos) AS INTEGER) AS code FROM (SELECT item, pos FROM {X.VOCAB.sql()} WHERE kind = 'branch' UNION ALL SELECT 'odd', 6) c
        LEFT JOIN (SELECT mnemonic, CAST(substr(funct3, 1, 1) AS INTEGER) * 4 + CAST(substr(funct3, 2, 1) AS INTEGER) * 2 + CAST(substr(funct3, 3, 1) AS INTEGER) AS f FROM {X.INSTRUCTIONS.sql()} WHERE format = 'B') i ON i.mnemonic = 'B' || upper(item)""",
    "icd_build": f"WITH {TABLE} SELECT * FROM icd",
    "icd_collisions": f"WITH {TABLE} SELECT opcode, funct3, CAST(NULL AS INTEGER) AS funct7b5, count(*) AS n, string_agg(mnemonic, ',' ORDER BY ord) AS mnemonics FROM icd GROUP BY opcode, funct3 HAVING count(*) > 1",
    "control_groups": f"""WITH {TABLE}, g AS (SELECT *, coalesce(funct3, '000') AS f3, count(*) OVER (PARTITION BY opcode) AS n_op, min(ord) OVER (PARTITION BY opcode) AS oo FROM icd),
        h AS (SELECT opcode, f3 AS funct3, oo, min(ord) AS fo, string_agg(mnemonic, ',' ORDER BY ord) AS mnemonics, max(n_op) = 1 AS single_opcode, count(*) = 1 AS single FROM g GROUP BY opcode, f3, oo)
        SELECT CAST(row_number() OVER (ORDER BY oo, fo) - 1 AS INTEGER) AS ord, opcode, funct3, mnemonics, single_opcode, single FROM h""",
    "cheatsheet": f"WITH {TABLE}, {SHEET} SELECT * FROM sheet",
    "control_arms": f"WITH {ARMS} SELECT * FROM arms",
    "control_text": f"WITH {ARMS}, ct AS ({_control}) SELECT * FROM ct",
    "immediate_arms": f"""WITH {ENC} SELECT code AS ord, item AS format, "binary", CASE item WHEN 'I' THEN 20 WHEN 'S' THEN 20 WHEN 'B' THEN 19 WHEN 'U' THEN 0 WHEN 'J' THEN 11 END AS sign_bits FROM enc WHERE kind = 'imm_type'""",
    "module_tiers": f"SELECT id, name, CASE WHEN name IN ('control', 'imm_gen') THEN 'truth_table' WHEN name IN ('instr_mem', 'data_mem', 'tb_cpu') THEN 'testbench_only' ELSE 'behavioral_logic' END AS tier FROM {G.MODULES.sql()}",
    "module_prompt": f"WITH {TABLE}, {SHEET} SELECT {X.literal(_task.format(m='alu') + SHEET_HEAD + '-' * 112)} || chr(10) || {_lines} || {_legends} || {X.literal(_end.format(m='alu'))} AS prompt",
    "top_module_prompt": f"WITH {TABLE}, {SHEET} SELECT {X.literal(_task.format(m='cpu') + SHEET_HEAD + '-' * 112)} || chr(10) || {_lines} || {_legends} || {X.literal(_heads + _end.format(m='cpu'))} AS prompt",
    "imm_decode": f"WITH {W} SELECT k, line, " + ", ".join(f"{e} AS imm_{f}" for f, e in _imm.items()) + " FROM w",
    "word_decode": f"""WITH {TABLE}, {W}, v AS (SELECT k, line, (word & 4294967168) | CASE WHEN line % 2 = 0 THEN 51 ELSE 99 END AS word FROM w)
        SELECT k, line, word, mnemonic FROM v LEFT JOIN icd ON opcode = lpad(bin({bit(6, 0)}), 7, '0') AND (funct3 IS NULL OR funct3 = lpad(bin({bit(14, 12)}), 3, '0')) AND (funct7b5 IS NULL OR funct7b5 = {bit(30, 30)})""",
    "alu_eval": f"WITH {AB} SELECT k, line, " + ", ".join(f"{e} AS r_{o.lower()}" for o, e in _alu.items()) + " FROM ab",
    "alu_vectors": f"WITH c AS (SELECT id, op, {_hexw('expected')} AS x, {_hexw('rs1')} AS a, {_hexw('rs2')} AS b FROM {CASES.sql()}) SELECT id, {_case} AS computed, {_case} = x AS passed FROM c",
    "branch_eval": f"WITH {AB} SELECT k, line, " + ", ".join(f"{e} AS t_{f}" for f, e in _taken.items()) + " FROM ab",
    "lane_mask": f"""WITH {AB}, z AS (SELECT *, CAST(k % 3 AS INTEGER) AS size, line % 2 = 0 AS un FROM ab), o AS (SELECT *, CASE size WHEN 2 THEN 0 WHEN 1 THEN a & 2 ELSE a & 3 END AS off, CASE size WHEN 0 THEN 255 WHEN 1 THEN 65535 ELSE {M} END AS ful, CASE size WHEN 0 THEN 128 WHEN 1 THEN 32768 ELSE 2147483648 END AS top FROM z),
        g AS (SELECT *, (b >> (off * 8)) & ful AS got FROM o)
        SELECT k, line, a & 4294967292 AS word_addr, CAST(CASE size WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 15 END << off AS INTEGER) AS strobe, ((b & ful) << (off * 8)) & {M} AS stored, CASE WHEN un THEN got ELSE (xor(got, top) - top) & {M} END AS loaded FROM g""",
    "next_pc": f"WITH {AB} SELECT k, line, CASE WHEN line % 3 = 1 AND line % 2 = 1 THEN (a + b) & {M} & 4294967294 WHEN line % 3 IN (0, 1) THEN (a + b) & {M} ELSE (a + 4) & {M} END AS pc FROM ab",
}
