"""Small inputs, and running options over them."""

from __future__ import annotations

import hashlib

from strandlake.operators.render import process
from strandlake.plans.options import build
from strandlake.sources.fastx import read_reads


def fastq(*records: tuple[str, str, str]) -> str:
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)


#: fixed values: inputs whose outputs have known digests
TWO = fastq(("read0", "AAGCTTCCGG", "KI;<)(,%#$"), ("read1", "AAGCTTCCGG", "I;<*,(,%#$"))
BOUND = fastq(("read1", "ATGAGT", "FFFFFF"), ("read2", "ACACTT", "FFFFFF"))
BOUND_FA = ">read1\nATGAGT\n>read2\nACACTT\n"
LEFT = """\
@read1
GATACTCCGGTTTTTTTTTTAAAAACCCCCGATACTCCGG
+
;I;<)(,%#$KI;<)(,%#$KI;<)(,%#$$$$$$$$$$$
@read2
ATGCTTCCGGTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read3
TAGAGAACACTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read4
TTAATTCCGGTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read5
TTGGTACTCCTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read6
CCTAGAGAATTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read7
GGTACTCCAATTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read8
TAGAGAACCTTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
"""
RIGHT = """\
@read1
GATACTCCGGTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;J;;;;;;
@read2
ATGCTTCCGGTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read3
TAGAGAACACTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read4
TTAATTCCGGTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read5
TTGGTACTCCTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read6
CCTAGAGAATTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read7
GGTACTCCAATTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
@read8
TAGAGAACCTTTTTTTTTTTAAAAACCCCC
+
KI;<)(,%#$KI;<)(,%#$KI;<)(,%#$
"""
NAMED = "@aaa 1:N:ATCCC+ATCG\nGGGGAGAGAGCGATAGACATA\n+\n" + "J" * 21 + "\n"
TERM = fastq(("rNYBot1_StgOdd2Bo1Part", "TATTATGGTCCCCCCCCTTCGTGGAATCTAGCAAAAAATGACTTGAGCTGGGGGGGGGG", "TATTATGGTCCCCCCCCTTCGTGGAATCTAGCTGACTTGTGACTAGCTDGGGGGGGGGG"))

#: fixed values: inputs and tag tables whose outputs have known digests
NANOPORE = """\
@90bcac51-a76b-476e-9518-2de3598af948
CTGCATCTCGTTCAGTTGCGTATTGCTGAGATATCCGACAGTGACTGGAGTTCAGACGTGTGCTCTTCCGATCTAGCCGGGACTGAGGTCCGCGATTCGTCTAGGATGCTGGCAAAATGGTCGTAAGCGGCCCGTCTTGAAACACGGACCAAGGAGTCTAACATCTAGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAAGCCTGAG
+
(((&#####$&446555..//-1111B@@ABDEJEGGDECBAAABADEEBBC84333599;951101245<=::989;9;BEEGA;1111A@@@@?ABABBDEDDEHI{KG{KDDEDDJGLGDEAA?>944432232222=EFCDCDBEDDABBCCEED???@AA@@CCCBAACDFHHEDEECFFB>>>??AA@@BBCA@@A@?>,(&
"""
NANOPORE_TAGS = """\
groups	ids	tags	distances	locations	previous	minFindsG
xx	xxx	AAAAAAAAAAAAAAAAA	0	0:-90:0	-
2Pbc	2Pbc_3prime_1	GTGACTGGAGTTCAGAC	0	0:30:120	-
2Pbc	2Pbc_3prime_2	GTGTGCTCTTCCGATCT	0	0:43:145	-
2Puni	2Puni_3prime_2_rc	GATCGGAAGAGCGTCG	0	-	{2Pbc_3prime_2}
"""
SPLIT = """\
@r1
TCTCCTTACGGACAACTGCCTAGTAGAAGACGTTTGACTTGATAGATTGTTGCGTGCTCACAACTGGATAGCACCGTTCATTTGACTTGTGTAGGTTCTGGAATATGACAACTGCTGTGTCTGTCACCTTTGACTTGTCA
+
TCTCCTTACGGACAACTGCCTAGTAGAAGACGTTTGACTTGATAGATTGTTGCGTGCTCACAACTGGATAGCACCGTTCATTTGACTTGTGTAGGTTCTGGAATATGACAACTGCTGTGTCTGTCACCTTTGACTTGTCA
"""
SPLIT_TAGS = """\
groups	ids	tags	distances	locations	previous
NYStgBot	Y18	TCTCCTTACG	0:0:0	0:0:11	-
NYStgBot	Y32	TGTAGTTCTA	0:1:1	0:0:11	-
OddBot3	O45	GCCTAGTAGAAGACGTT	2:2:2	0:11:0	{{NYStgBot}}4-10
EvenBot2	E41	ATAGATTGTTGCGTGCT	2:2:2	0:11:0	{{OddBot3}}4-10
OddBot2	O21	GGATAGCACCGTTCATT	1:1:1	0:11:0	{{EvenBot2}}4-10
EvenBot1	E2	TGTAGGTTCTGGAATAT	0:0:0	0:11:0	{{OddBot2}}4-10
OddBot1	O85	GCTGTGTCTGTCACCT	1:1:1	0:11:0	{{EvenBot1}}4-10
DPM_const	DPM_const	TCATGTCTTCCGATCT	2:0:2	0:11:0	{{OddBot1}}4-10
DPM_R2	DPM1	TGGGTGTTT	1:0:1	0:11:0	{DPM_const}0-0
"""
BOUNDS = """\
@r
NNNNNNNNNNTGACTTGTGTAGGTTCTGGAAT
+
NNNNNNNNNNTGACTTGTGTAGGTTCTGGAAT
"""
BOUNDS_TAGS = """\
tags	locations
TGTAGG  0:0:0
TGTAGGTT	0:0:0
TGGG	0:0:0
"""
POLY = """\
@11_bp_no_mismatch
AAATTTTTTTTTTTAAA
+
;;;;;;;;;;;;;;;;;
@11_bp_1_internal_mismatch
AAATTTTTTTTTCTAAA
+
;;;;;;;;;;;;;;;;;
@11_bp_1_internal_mismatch2
AAATTTTTTTTCTTAAA
+
;;;;;;;;;;;;;;;;;
@11_bp_1_5prime_mismatch
AAACTTTTTTTTTTAAA
+
;;;;;;;;;;;;;;;;;
@11_bp_1_3prime_mismatch
AAATTTTTTTTTTCAAA
+
;;;;;;;;;;;;;;;;;

"""
POLY_TAGS = """\
ids	tags	distance
tagT	TTT	0
tagT	TTTT	0
tagT	TTTTT	0
tagT	TTTTTT	0
tagT	TTTTTTT	0
tagT	TTTTTTTT	0
tagT	TTTTTTTTT	0
tagT	TTTTTTTTTT	1
tagT	TTTTTTTTTTT	1
tagT	TTTTTTTTTTTT	1
tagT	TTTTTTTTTTTTT	1
tagT	TTTTTTTTTTTTTT	1
tagT	TTTTTTTTTTTTTTT	1

"""
ENDS = """\
@read1 5prime tagT
TTTTTTTTTT
+
;;;;;;;;;;
@read2 5prime tagT with 3prime substitution
TTTTTTTTTC
+
;;;;;;;;;;
@read3 5prime tagT with interior substitution
TTTCTTTTTT
+
;;;;;;;;;;
@read4 5prime tagT with interior substitution within first 3 bp
TTCTTTTTTT
+
;;;;;;;;;;
@read5 5prime tagT with interior substitution within first 3 bp
TCTTTTTTTT
+
;;;;;;;;;;
@read6 5prime tagT with 5prime substitution
CTTTTTTTTT
+
;;;;;;;;;;
@read7 5prime tagT with 5prime and 3prime substitutions
CTTTTTTTTC
+
;;;;;;;;;;
@read8 5prime tagT with 5prime and interior substitutions
CTTTTTTCTT
+
;;;;;;;;;;
@read9 5prime tagA with 5prime and interior substitutions; like read3
AAACAAAAAA
+
;;;;;;;;;;
@read10 5prime tagG with 5prime and interior substitutions; like read3
GGGCGGGGGG
+
;;;;;;;;;;

"""
ENDS_TAGS = """\
ids	tags	distance	partial5
tagT	TTTTTTTTTT	0	3:0.2
tagA	AAAAAAAAAA	1	3:0.2
tagG	GGGGGGGGGG	1	-

"""


def run(spark, folder, texts: list[str] | list[list[str]], **options):
    """(stream -> text, [(layer, reads)]) of options over the texts of the files of one run, or of several."""
    runs = [texts] if isinstance(texts[0], str) else texts
    paths = []
    for i, files in enumerate(runs):
        paths.append([])
        for j, text in enumerate(files):
            path = folder / f"in_{i}_{j}.{'fa' if text.startswith('>') else 'fq'}"
            path.write_text(text)
            paths[-1].append(str(path))
    layer, out = build(n_files=len(runs[0]), **options)
    recs, layers = process(read_reads(spark, paths), layer, out)
    streams: dict[str, str] = {}
    for r in recs.orderBy("read_id", "nth").collect():
        streams[r.stream] = streams.get(r.stream, "") + r.text
    return streams, layers


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()
