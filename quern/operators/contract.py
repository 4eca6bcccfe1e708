"""Contract tables: dense encodings of vocabularies, the joined instruction control table, its checks, and text rendered
from it. Small tables, so dimension sides are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import bits

#: Kinds of vocabulary that must not be empty, and the bits that a kind has whatever its size.
KINDS = ("alu", "mem_size", "imm_type", "writeback", "branch")
BRANCH_BITS = 3
#: Branch conditions and the instructions whose funct3 encodes them.
CONDITIONS = {"EQ": "BEQ", "NE": "BNE", "LT": "BLT", "GE": "BGE", "LTU": "BLTU", "GEU": "BGEU"}
#: How a module is made.
TIERS = {
    "truth_table": ("control", "imm_gen"),
    "behavioral_logic": ("regfile", "alu", "branch_unit", "load_store", "pc_next", "cpu"),
    "testbench_only": ("instr_mem", "data_mem", "tb_cpu"),
}
#: Bits that an immediate's sign is not copied into.
SIGN_BITS = {"I": 12, "S": 12, "B": 13, "U": None, "J": 21}


#: What the facts call each kind, and the errors that a missing one gives.
FACTS = {"alu": "alu_operations", "mem_size": "memory_sizes", "imm_type": "immediate_formats", "writeback": "writeback_sources", "branch": "branch_conditions"}
MISSING_FIRST = "Missing 'alu_operations'. The Stage 1 LLM may have rate-limited or hallucinated invalid JSON."
MISSING = "Missing '{}' from Stage 1 facts. Ensure Stage 1 succeeded."
#: Ports as (direction, name, bits); bits may be the kind whose width they have.
PORTS = {
    "regfile": (("input", "clk", 1), ("input", "we", 1), ("input", "rs1", 5), ("input", "rs2", 5), ("input", "rd", 5), ("input", "rd_data", 32), ("output", "rd1", 32), ("output", "rd2", 32)),
    "imm_gen": (("input", "instr", 32), ("input", "imm_type", "imm_type"), ("output", "imm", 32)),
    "alu": (("input", "a", 32), ("input", "b", 32), ("input", "alu_op", "alu"), ("output", "result", 32), ("output", "zero", 1)),
    "branch_unit": (("input", "branch_type", 3), ("input", "rs1", 32), ("input", "rs2", 32), ("input", "branch", 1), ("output", "taken", 1)),
    "load_store": (
        ("input", "mem_read", 1), ("input", "mem_write", 1), ("input", "mem_size", "mem_size"), ("input", "mem_extend", 1), ("input", "addr", 32), ("input", "wdata", 32), ("input", "mem_rdata", 32),
        ("output", "rdata", 32), ("output", "mem_addr", 32), ("output", "mem_wdata", 32), ("output", "mem_wstrb", 4),
    ),
    "control": (
        ("input", "opcode", 7), ("input", "funct3", 3), ("input", "funct7b5", 1), ("output", "alu_op", "alu"), ("output", "alu_src_b", 1), ("output", "alu_src_a", 2), ("output", "result_src", "writeback"), ("output", "reg_write", 1),
        ("output", "mem_read", 1), ("output", "mem_write", 1), ("output", "mem_size", "mem_size"), ("output", "mem_extend", 1), ("output", "branch", 1), ("output", "branch_type", 3), ("output", "jump", 1), ("output", "jump_type", 1),
        ("output", "imm_type", "imm_type"),
    ),
    "pc_next": (("input", "pc", 32), ("input", "imm", 32), ("input", "rs1", 32), ("input", "taken", 1), ("input", "jump", 1), ("input", "jump_type", 1), ("output", "next_pc", 32)),
}
#: Headings of the sheets.
SHEET_TITLE = "=== MICROARCH WIRING CHEATSHEET (use ONLY these values) ==="
LEGACY_TITLE = "=== ISA WIRING CHEATSHEET (binary constants only — use these EXACTLY) ==="
LEGENDS = {
    "alu": "=== ALU_OP ENCODING (canonical — alu.v and control.v MUST match) ===",
    "imm_type": "=== IMM_TYPE ENCODING (canonical — imm_gen.v and control.v MUST match) ===",
    "branch": "=== BRANCH funct3 ENCODING (canonical — branch_unit.v MUST use these) ===",
}


def encode_vocabulary(vocab: DataFrame) -> DataFrame:
    """kind, item, code, width, binary from (kind, pos, item): codes from 0 in order of first appearance. The width tells
    all listed entries apart, repeated ones too, imm_type one more, and branch has three bits."""
    w = Window.partitionBy("kind")
    n = vocab.groupBy("kind").agg(F.count("*").alias("n"))
    width = F.when(F.col("kind") == "branch", F.lit(BRANCH_BITS)).otherwise(bits.min_bits(F.col("n") + F.when(F.col("kind") == "imm_type", F.lit(1)).otherwise(F.lit(0))))
    items = vocab.groupBy("kind", "item").agg(F.min("pos").alias("pos")).withColumn("code", (F.row_number().over(w.orderBy("pos")) - 1).cast("int"))
    return items.join(F.broadcast(n), "kind").withColumn("width", width).withColumn("binary", bits.to_binary(F.col("code").cast("bigint"), F.col("width"))).select("kind", "item", "code", "width", "binary")


def check_vocabulary(vocab: DataFrame) -> DataFrame:
    """kind, error of the vocabulary kinds that have no entry; none if all have."""
    rows = [(k, MISSING_FIRST if k == KINDS[0] else MISSING.format(FACTS[k])) for k in KINDS]
    kinds = vocab.sparkSession.createDataFrame(rows, "kind string, error string")
    return kinds.join(vocab.select("kind"), "kind", "left_anti")


def encode_branches(vocab: DataFrame, instructions: DataFrame) -> DataFrame:
    """item, code: the funct3 of the condition's branch instruction; of an unknown condition, its place in the list."""
    return _coded(vocab, instructions).select("item", "code")


def branch_legend(vocab: DataFrame, instructions: DataFrame) -> DataFrame:
    """ord, item, code: the conditions in the order of the list."""
    return _coded(vocab, instructions).select(F.col("nth").alias("ord"), "item", "code")


def _coded(vocab: DataFrame, instructions: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    b = instructions.filter("format = 'B' AND funct3 IS NOT NULL").select("mnemonic", F.conv("funct3", 2, 10).cast("int").alias("f3"))
    c = vocab.filter("kind = 'branch'").groupBy("item").agg(F.min("pos").alias("pos")).withColumn("nth", F.row_number().over(Window.orderBy("pos")) - 1).withColumn("name", F.try_element_at(names, F.upper("item")))
    return c.join(F.broadcast(b), F.col("name") == F.col("mnemonic"), "left").select("nth", "item", F.coalesce("f3", "nth").cast("int").alias("code"))


def control_table(instructions: DataFrame, behaviour: DataFrame, encodings: DataFrame) -> DataFrame:
    """The instruction control table: ord, mnemonic, format, opcode, funct3, funct7b5, codes, sources and flags.

    Every instruction needs a behaviour, told by its name in upper case, or reading the table fails with its name; of
    behaviours of one name the last counts, others are ignored. An unknown or missing alu operation or writeback source
    gets code 0 (missing ones as ADD and ALU); an unknown immediate format or memory size gets none.
    """
    latest = Window.partitionBy(F.upper("mnemonic")).orderBy(F.desc("ord"))
    b = behaviour.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").select(F.upper("mnemonic").alias("key"), F.lit(True).alias("known"), *[c for c in behaviour.columns if c not in ("mnemonic", "ord")])
    code = lambda kind, name: F.broadcast(encodings.filter(F.col("kind") == kind).select(F.col("item").alias(f"{name}_item"), F.col("code").alias(f"{name}_code")))
    t = instructions.join(F.broadcast(b), F.upper("mnemonic") == F.col("key"), "left")
    t = t.withColumn("mnemonic", F.when(F.col("known"), F.upper("mnemonic")).otherwise(F.raise_error(F.concat(F.lit("no behaviour for instruction "), F.upper("mnemonic"))).cast("string")))
    t = (
        t.join(code("alu", "a"), F.coalesce("alu_op", F.lit("ADD")) == F.col("a_item"), "left")
        .join(code("writeback", "w"), F.coalesce("writeback", F.lit("ALU")) == F.col("w_item"), "left")
        .join(code("imm_type", "i"), F.col("format") == F.col("i_item"), "left")
        .join(code("mem_size", "m"), F.col("mem_size") == F.col("m_item"), "left")
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return t.select(
        "ord", "mnemonic", "format", "opcode", "funct3", "funct7b5", F.coalesce("a_code", F.lit(0)).alias("alu_op"), F.col("i_code").alias("imm_type"), F.coalesce("w_code", F.lit(0)).alias("writeback"), F.col("m_code").alias("mem_size"),
        F.coalesce("alu_src_a", F.lit("rs1")).alias("alu_src_a"), F.coalesce("alu_src_b", F.lit("rs2")).alias("alu_src_b"), *map(flag, ("reg_write", "mem_read", "mem_write", "branch", "jump")), "mem_extend", "jump_type",
    )


def collisions(table: DataFrame) -> DataFrame:
    """opcode, funct3, funct7b5, n, mnemonics of keys that several instructions share; nulls are equal."""
    return table.groupBy("opcode", "funct3", "funct7b5").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "mnemonic"))), lambda x: x["mnemonic"]), ",").alias("mnemonics")).filter("n > 1")


def checked(table: DataFrame) -> DataFrame:
    """The table; reading it fails if two instructions share a key."""
    w = Window.partitionBy("opcode", "funct3", "funct7b5")
    clash = F.raise_error(F.concat(F.lit("instructions share a key: "), "mnemonic")).cast("string")
    return table.withColumn("__n", F.count("*").over(w)).withColumn("mnemonic", F.when(F.col("__n") == 1, F.col("mnemonic")).otherwise(clash)).drop("__n")


def control_groups(table: DataFrame) -> DataFrame:
    """ord, opcode, funct3, mnemonics, single_opcode, single: opcodes in order of first instruction, then funct3 (null is
    000) in the same order; single_opcode: the opcode has one instruction; single: the pair has one."""
    g = table.withColumn("f3", F.coalesce("funct3", F.lit("000"))).withColumn("n_op", F.count("*").over(Window.partitionBy("opcode"))).withColumn("op_ord", F.min("ord").over(Window.partitionBy("opcode")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "mnemonic"))), lambda x: x["mnemonic"]), ",")
    g = g.groupBy("opcode", F.col("f3").alias("funct3"), "op_ord").agg(F.min("ord").alias("f3_ord"), names.alias("mnemonics"), (F.max("n_op") == 1).alias("single_opcode"), (F.count("*") == 1).alias("single"))
    w = Window.orderBy("op_ord", "f3_ord")
    return g.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).select("ord", "opcode", "funct3", "mnemonics", "single_opcode", "single")


def _widths(encodings: DataFrame) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("width"))).alias(f"{k}_w")
    return encodings.agg(*(pick(k) for k in KINDS))


def enriched(table: DataFrame, encodings: DataFrame) -> DataFrame:
    """The table with widths and binary strings of its codes."""
    b = lambda c, w: bits.to_binary(F.col(c).cast("bigint"), F.col(w))
    return table.crossJoin(F.broadcast(_widths(encodings))).withColumns(
        {"bin_alu_op": b("alu_op", "alu_w"), "bin_imm_type": b("imm_type", "imm_type_w"), "bin_writeback": b("writeback", "writeback_w"), "bin_mem_size": b("mem_size", "mem_size_w"), "bin_alu_src_a": bits.source_a(F.col("alu_src_a"))}
    )


def cheatsheet_lines(table: DataFrame, encodings: DataFrame) -> DataFrame:
    """ord, line: a wiring line for each instruction. A memory size is printed with the writeback's width before it."""
    e = enriched(table, encodings)
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    line = F.format_string(
        "%-8s| %-7s | %-3s | %-4s | %d'b%s| %d'b%s| %d'b%s| %d  | %d  | %d  | %d  | %d   | %-6s | %-5s | %d'b%s",
        "mnemonic", "opcode", F.coalesce("funct3", F.lit("---")), F.coalesce(F.col("funct7b5").cast("string"), F.lit("-")), "alu_w", "bin_alu_op", "imm_type_w", na(F.col("bin_imm_type")), "writeback_w", "bin_writeback",
        "reg_write", "mem_read", "mem_write", "branch", "jump", "alu_src_a", "alu_src_b", "writeback_w", na(F.col("bin_mem_size")),
    )
    return e.select("ord", line.alias("line"))


def joined(lines: DataFrame, name: str = "text") -> DataFrame:
    """One row: the lines in order of ord."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias(name))


def _range(bits_of: Column) -> Column:
    """[n:0] and a blank, of one bit nothing."""
    return F.when(bits_of == 1, "").otherwise(F.concat(F.lit("["), (bits_of - 1).cast("string"), F.lit(":0] ")))


def _bits(size: int | str) -> Column:
    return F.lit(size) if isinstance(size, int) else F.col(f"{size}_w")


def signature(module: str) -> Column:
    """The module's head, over a row of _widths."""
    ports = [F.concat(F.lit(f"    {way} logic "), _range(_bits(size)), F.lit(name)) for way, name, size in PORTS[module]]
    return F.concat(F.lit(f"module {module} (\n"), F.concat_ws(",\n", *ports), F.lit("\n);"))


def cheatsheet(table: DataFrame, encodings: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """One row, text: the wiring sheet with heading, columns and rule; with branches (item, code), also the legends of the
    operations, immediate formats and branch conditions, under a rule of 112 instead of 110."""
    column = lambda name, kind, more: F.lpad(F.lit(name), F.col(f"{kind}_w") + more, " ")
    heads = F.concat(
        F.lit(SHEET_TITLE + "\nINSTR   | opcode  | f3  | f7b5 | "), column("alu_op", "alu", 5), F.lit("| "), column("imm", "imm_type", 3), F.lit("| "), column("wb", "writeback", 3),
        F.lit("| rw | mr | mw | br | jmp | alu_a  | alu_b | mem_sz\n" + "-" * (110 if branches is None else 112) + "\n"),
    )
    out = joined(cheatsheet_lines(table, encodings), "lines").crossJoin(F.broadcast(_widths(encodings))).withColumn("text", F.concat(heads, "lines"))
    if branches is not None:
        coded = encodings.filter("kind IN ('alu', 'imm_type')").select("kind", F.col("code").alias("ord"), "item", "width", "binary")
        by_place = branches.select(F.lit("branch").alias("kind"), "ord", "item", F.lit(BRANCH_BITS).alias("width"), bits.to_binary(F.col("code").cast("bigint"), BRANCH_BITS).alias("binary"))
        line = F.concat(F.lit("  "), F.col("width").cast("string"), F.lit("'b"), "binary", F.lit(" = "), "item", F.when(F.col("kind") == "imm_type", "-type").otherwise(""))
        text = coded.unionByName(by_place).select("kind", F.struct("ord", line.alias("line")).alias("l"))
        of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("l")))), lambda x: x["line"]), "\n")
        legends = text.agg(F.concat(*(x for k, title in LEGENDS.items() for x in (F.lit(f"\n\n{title}\n"), of(k)))).alias("legends"))
        out = out.crossJoin(F.broadcast(legends)).withColumn("text", F.concat("text", "legends"))
    return out.select("text")


def _assign(name: str, width: Column | int, value: Column) -> Column:
    return F.concat(F.lit(f"{name} = "), (F.lit(width) if isinstance(width, int) else width).cast("string"), F.lit("'b"), value.cast("string"), F.lit(";"))


def control_arms(table: DataFrame, encodings: DataFrame) -> DataFrame:
    """opcode, funct3, funct7b5, ord, body: the assignments of each instruction's decoder arm. An arm that only funct7b5
    tells apart sets the operation, second source, result, register write and immediate alone."""
    e = enriched(table, encodings).withColumn("f3", F.coalesce("funct3", F.lit("000")))
    e = e.withColumn("n_op", F.count("*").over(Window.partitionBy("opcode"))).withColumn("n_f3", F.count("*").over(Window.partitionBy("opcode", "f3")))
    split = (F.col("n_op") > 1) & (F.col("n_f3") > 1)
    wide = lambda c: F.when(~split, c)
    one = lambda c: F.when(c, "1").otherwise("0")
    mem = F.col("mem_size").isNotNull()
    body = F.concat_ws(
        " ",
        _assign("alu_op", F.col("alu_w"), F.col("bin_alu_op")), _assign("alu_src_b", 1, one(F.col("alu_src_b") == "imm")), wide(_assign("alu_src_a", 2, F.col("bin_alu_src_a"))), _assign("result_src", F.col("writeback_w"), F.col("bin_writeback")),
        _assign("reg_write", 1, F.col("reg_write")), wide(_assign("mem_read", 1, F.col("mem_read"))), wide(_assign("mem_write", 1, F.col("mem_write"))), wide(F.when(mem, _assign("mem_size", F.col("mem_size_w"), F.col("bin_mem_size")))),
        wide(F.when(mem, _assign("mem_extend", 1, one(F.coalesce(F.col("mem_extend") == "unsigned", F.lit(False)))))), wide(_assign("branch", 1, F.col("branch"))), wide(F.when((F.col("branch") == 1) & (F.col("n_op") > 1), _assign("branch_type", 3, F.col("f3")))),
        wide(_assign("jump", 1, F.col("jump"))), wide(F.when(F.col("jump") == 1, _assign("jump_type", 1, one(F.coalesce(F.col("jump_type") == "jalr", F.lit(False)))))), F.when(F.col("imm_type").isNotNull(), _assign("imm_type", F.col("imm_type_w"), F.col("bin_imm_type"))),
    )
    return e.select("opcode", F.when(F.col("n_op") > 1, F.col("f3")).alias("funct3"), F.when(split, F.col("funct7b5")).alias("funct7b5"), "ord", "mnemonic", body.alias("body"))


def control_module(table: DataFrame, encodings: DataFrame) -> DataFrame:
    """One row, text: the control decoder: its ports, a default of 0 for every output, which stands wherever an arm says
    nothing, and a nested case over opcode, funct3 and funct7b5."""
    arms = control_arms(table, encodings).withColumn("op_ord", F.min("ord").over(Window.partitionBy("opcode"))).withColumn("f3_ord", F.min("ord").over(Window.partitionBy("opcode", "funct3")))
    inner = F.when(F.col("funct7b5").isNotNull(), F.concat(F.lit("if (funct7b5 == 1'b"), "funct7b5", F.lit(") begin "), "body", F.lit(" end"))).otherwise(F.col("body"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("line")))), lambda x: x["line"]), "\n")
    f3 = arms.groupBy("opcode", "op_ord", "funct3", "f3_ord").agg(ordered(inner).alias("line")).withColumn("ord", F.col("f3_ord"))
    f3 = f3.withColumn("line", F.when(F.col("funct3").isNull(), F.col("line")).otherwise(F.concat(F.lit("3'b"), "funct3", F.lit(": begin "), "line", F.lit(" end"))))
    op = f3.groupBy("opcode", "op_ord").agg(ordered(F.col("line")).alias("line"), F.max("funct3").alias("any")).withColumn("ord", F.col("op_ord"))
    op = op.withColumn("line", F.concat(F.lit("7'b"), "opcode", F.lit(": begin\n"), F.when(F.col("any").isNull(), F.col("line")).otherwise(F.concat(F.lit("case (funct3)\n"), "line", F.lit("\ndefault: begin end\nendcase"))), F.lit("\nend")))
    defaults = F.concat_ws("\n", *(_assign(name, _bits(size), F.lit("0")) for way, name, size in PORTS["control"] if way == "output"))
    head, tail = F.concat(signature("control"), F.lit("\nalways_comb begin\n"), defaults, F.lit("\ncase (opcode)\n")), F.lit("\ndefault: begin end\nendcase\nend\nendmodule")
    return joined(op.select("ord", "line"), "body").crossJoin(F.broadcast(_widths(encodings))).select(F.concat(head, "body", tail).alias("text"))


def immediate_arms(encodings: DataFrame, xlen: int = 32) -> DataFrame:
    """ord, format, binary, sign_bits: how often each format repeats the sign."""
    sign = F.create_map(*[F.lit(x) for f, b in SIGN_BITS.items() for x in (f, 0 if b is None else xlen - b)])
    return encodings.filter("kind = 'imm_type'").select(F.col("code").alias("ord"), F.col("item").alias("format"), "binary", F.try_element_at(sign, "item").alias("sign_bits"))


def module_tier(name: Column) -> Column:
    """How a module is made; an unknown one fails."""
    out = F.when(F.lit(False), F.lit(""))
    for tier, names in TIERS.items():
        out = out.when(name.isin(*names), tier)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown module "), name)).cast("string"))


def decode(words: DataFrame, table: DataFrame) -> DataFrame:
    """words (word and others) with the mnemonic that they encode, null for none: keys that the table leaves open match
    anything."""
    f = bits.fields(F.col("word"))
    w = words.withColumns({"w_opcode": f["opcode"], "w_funct3": f["funct3"], "w_funct7b5": f["funct7b5"]})
    t = F.broadcast(table.select(F.col("opcode").alias("t_op"), F.col("funct3").alias("t_f3"), F.col("funct7b5").alias("t_f7"), "mnemonic"))
    on = (F.col("w_opcode") == F.col("t_op")) & (F.col("t_f3").isNull() | (F.col("t_f3") == F.col("w_funct3"))) & (F.col("t_f7").isNull() | (F.col("t_f7") == F.col("w_funct7b5")))
    return w.join(t, on, "left").select(*words.columns, "mnemonic")


def microarch(table: DataFrame, encodings: DataFrame, name: str, xlen: int = 32) -> DataFrame:
    """One row, document: the whole contract as JSON."""
    enc = encodings.groupBy("kind").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("code", "item", "binary"))).alias("encoding"))
    rows = table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias("instruction_icd"))
    kinds = enc.agg(F.array_sort(F.collect_list(F.struct("kind", "width", "encoding"))).alias("vocabularies"))
    return rows.crossJoin(kinds).select(F.to_json(F.struct(F.lit(name).alias("architecture"), F.lit(xlen).alias("xlen"), "vocabularies", "instruction_icd")).alias("document"))


def read_microarch(documents: DataFrame, table: DataFrame) -> DataFrame:
    """The control table's rows back from documents of microarch()."""
    schema = f"instruction_icd array<{table.schema.simpleString()}>"
    return documents.select(F.inline(F.from_json("document", schema)["instruction_icd"])).select(*table.columns)


def module_prompt(module: str, table: DataFrame, encodings: DataFrame, branches: DataFrame, name: str = "RV32I", xlen: int = 32) -> DataFrame:
    """One row, prompt: the request for a behavioural module: what it is for, the sheet with its legends, and for the top
    module the heads of all modules that it wires, leaves first."""
    order = ("regfile", "imm_gen", "control", "alu", "branch_unit", "load_store", "pc_next")
    task = f"Write the module {module}.\nArchitecture: {name}, XLEN {xlen}, single-cycle, no pipeline registers.\nReset PC: 0x00000000. x0 is zero; JALR clears the lowest bit.\nUse these encodings and no others.\n\n"
    heads = F.concat_ws("\n\n", F.lit("Instantiate these modules in this order and connect ports by name:"), *(signature(m) for m in order))
    ports = F.concat(F.lit("\n\n"), heads) if module == "cpu" else F.lit("")
    sheet = cheatsheet(table, encodings, branches).crossJoin(F.broadcast(_widths(encodings)))
    return sheet.select(F.concat(F.lit(task), "text", ports, F.lit(f"\n\nAnswer with the module {module} alone, without a test bench.")).alias("prompt"))


#: Where an immediate's bits stand in the instruction, by format.
IMMEDIATE_BITS = {"I": "instr[31:20]", "S": "instr[31:25], instr[11:7]", "B": "instr[31], instr[7], instr[30:25], instr[11:8], 1'b0", "U": "instr[31:12], 12'b0", "J": "instr[31], instr[19:12], instr[20], instr[30:21], 1'b0"}
#: Codes of the older wiring sheet's operations, in their order.
LEGACY_OPS = "ADD SUB SLL SLT SLTU XOR SRL SRA OR AND".split()


def immediate_module(encodings: DataFrame, xlen: int = 32) -> DataFrame:
    """One row, text: the immediate generator as a case over the known formats, in order of code."""
    parts = F.create_map(*[F.lit(x) for kv in IMMEDIATE_BITS.items() for x in kv])
    arms = immediate_arms(encodings, xlen).withColumn("bits", F.try_element_at(parts, "format")).filter("bits IS NOT NULL")
    sign = F.when(F.col("sign_bits") > 0, F.concat(F.lit("{"), F.col("sign_bits").cast("string"), F.lit("{instr[31]}}, "))).otherwise("")
    arm = F.concat(F.length("binary").cast("string"), F.lit("'b"), "binary", F.lit(": imm = {"), sign, "bits", F.lit("};"))
    head, tail = F.concat(signature("imm_gen"), F.lit("\nalways_comb begin\ncase (imm_type)\n")), F.lit(f"\ndefault: imm = {xlen}'b0;\nendcase\nend\nendmodule")
    return joined(arms.select("ord", arm.alias("line")), "body").crossJoin(F.broadcast(_widths(encodings))).select(F.concat(head, "body", tail).alias("text"))


def table_modules(table: DataFrame, encodings: DataFrame) -> DataFrame:
    """module, text of every module that is made from tables alone."""
    made = {"control": control_module(table, encodings), "imm_gen": immediate_module(encodings)}
    parts = [made[m].select(F.lit(m).alias("module"), "text") for m in TIERS["truth_table"]]
    return parts[0].unionByName(parts[1])


def legacy_lines(records: DataFrame) -> DataFrame:
    """ord, line of the older wiring sheet, from (ord, instruction, opcode, funct3, funct7, alu_op, reg_write, mem_read,
    mem_write, branch, jump, imm_type, alu_src_a, alu_src_b, result_src, mem_size, mem_extend, branch_type, jump_type): rows
    without an instruction are left out, N/A stands for nothing, and bit five of funct7 is told by 0100000."""
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    bit = F.when(na("funct7") == "N/A", "-").when(F.col("funct7") == "0100000", "1").otherwise("0")
    codes = F.create_map(*[F.lit(x) for i, o in enumerate(LEGACY_OPS) for x in (o, f"4'b{i:04b}")])
    op = F.coalesce("alu_op", F.lit("ADD"))
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("reg_write", "mem_read", "mem_write", "branch", "jump")]
    rest = [na(c) for c in ("alu_src_a", "alu_src_b", "result_src", "mem_size", "mem_extend", "branch_type", "jump_type")]
    line = F.format_string(
        "%-6s| %-7s | %-3s | %-4s | %-8s| %-6s| %d  | %d  | %d  | %d  | %d   | %-6s| %-5s | %-7s| %-5s| %-5s| %-7s| %s",
        "instruction", "opcode", F.when(F.col("funct3") == "N/A", "---").otherwise(F.col("funct3")), bit, F.coalesce(F.try_element_at(codes, op), op), na("imm_type"), *flags, *rest,
    )
    return records.filter("instruction IS NOT NULL").select("ord", line.alias("line"))


def legacy_sheet(records: DataFrame) -> DataFrame:
    """One row, text: the older sheet with heading, columns and rule."""
    heads = f"{LEGACY_TITLE}\nINSTR | opcode  | f3  | f7b5 | alu_op  | imm   | rw | mr | mw | br | jmp | alu_a | alu_b | res_src| m_sz | m_ext| br_type| jmp_t\n" + "-" * 125 + "\n"
    return joined(legacy_lines(records)).select(F.concat(F.lit(heads), "text").alias("text"))


def plan_edges(plans: DataFrame) -> DataFrame:
    """plan, place, module, depends_on (null for a leaf) from (plan, document): the modules of a plan's JSON."""
    schema = "modules array<struct<name:string,depends_on:array<string>>>"
    m = plans.select("plan", F.posexplode(F.from_json("document", schema)["modules"]).alias("place", "m"))
    return m.select("plan", F.col("place").cast("int").alias("place"), F.col("m.name").alias("module"), F.explode_outer("m.depends_on").alias("depends_on"))


def all_questions(base: DataFrame, dynamic: DataFrame) -> DataFrame:
    """key, question: base questions and dynamic ones (pos from 0), which are named by their place from 1."""
    return base.select("key", "question").unionByName(dynamic.select(F.concat(F.lit("dynamic_query_"), (F.col("pos") + 1).cast("string")).alias("key"), "question"))


def testbench(name: str, hex_file: str, depth: int, to_host: int) -> str:
    """A simulation frame around the processor: clock, reset, memory from a hex file, and the end at a store to `to_host`.
    Memory arrays stand here alone."""
    return f"""`timescale 1ns/1ps
// {name}, {depth} words
module tb_cpu;
logic clk = 0, resetn = 0;
always #5 clk = ~clk;
initial begin #20 resetn = 1; end
logic [31:0] mem [0:{depth - 1}];
initial $readmemh("{hex_file}", mem);
logic [31:0] imem_addr, mem_addr, mem_wdata;
logic [3:0] mem_wstrb;
cpu dut(.clk(clk), .resetn(resetn), .imem_addr(imem_addr), .imem_rdata(mem[imem_addr[31:2]]), .mem_addr(mem_addr), .mem_wdata(mem_wdata), .mem_wstrb(mem_wstrb), .mem_rdata(mem[mem_addr[31:2]]));
integer i;
always @(posedge clk) begin
  for (i = 0; i < 4; i = i + 1) if (mem_wstrb[i]) mem[mem_addr[31:2]][8*i +: 8] <= mem_wdata[8*i +: 8];
  if (mem_wstrb != 0 && mem_addr == 32'h{to_host:08x}) begin
    if (mem_wdata == 1) $display("TOHOST:PASS"); else $display("TOHOST:FAIL:%0d", mem_wdata >> 1);
    $finish;
  end
end
endmodule
"""
