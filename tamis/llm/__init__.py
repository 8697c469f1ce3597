"""Operations of a large-scale training-data pipeline, ten in number.

Nothing outside this subpackage imports it. Each module holds one operator with its general
interface; ``queries`` applies them to the driver tables.
"""
