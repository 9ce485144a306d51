"""Column types of the tables of an interaction network."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


INT, LONG, FLOAT, DOUBLE, STRING = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()

VERTICES = _table(
    vertex_id=LONG, label=STRING, kind=STRING, residue_name=STRING, residue_id=INT, molecule_type=STRING,
    molecule_instance=INT, atom_nr=INT, atom_name=STRING, atom_type=STRING, charge=DOUBLE, members=INT,
)
MEMBERS = _table(vertex_id=INT, atom_index=INT, atom_nr=INT)
EDGES = _table(edge_key=LONG, vertex1=INT, vertex2=INT)
VALUES = _table(frame=INT, edge_key=LONG, vdw=FLOAT, coulomb=FLOAT, vdw_dif=FLOAT, coulomb_dif=FLOAT, n_atom_pairs=INT)
ATOMS = _table(
    atom_index=INT, atom_nr=INT, residue_id=INT, residue_name=STRING, molecule_type=STRING, molecule_instance=INT,
    atom_name=STRING, atom_type=STRING, charge=DOUBLE,
)
VDW_TYPES = _table(type_i=STRING, type_j=STRING, sigma=DOUBLE, epsilon=DOUBLE, source=STRING)
EXCLUSIONS = _table(i=INT, j=INT)
POSITIONS = _table(frame=INT, atom_index=INT, x=DOUBLE, y=DOUBLE, z=DOUBLE)
BOXES = _table(frame=INT, lx=DOUBLE, ly=DOUBLE, lz=DOUBLE, alpha=DOUBLE, beta=DOUBLE, gamma=DOUBLE)
