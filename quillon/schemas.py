"""Row types of the data model, and the closed sets of its enumerations."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(spec: str, **kinds) -> StructType:
    simple = {"s": StringType(), "b": BooleanType(), "i": IntegerType(), "l": LongType(), "f": FloatType(), "d": DoubleType(), "t": TimestampType(), "as": ArrayType(StringType()), "af": ArrayType(FloatType())}
    return StructType([StructField(name, simple.get(kind) or kinds[kind]) for name, kind in (x.split(":") for x in spec.split())])


# The closed sets.
SOURCE_KINDS = ("whatsapp", "instagram", "sms", "mms", "photo", "imessage")
FACT_KINDS = ("person", "place", "event", "relationship", "habit", "preference")
HISTORY_EVENTS = ("ADD", "UPDATE", "EXPIRE")
WINDOW_OUTCOMES = ("extracted", "gave_up")
PROPOSAL_STATES = ("pending", "confirmed", "rejected")
#: Labels of the image tagger in their order, which breaks ties; and those that get no further look.
TAG_LABELS = ("people", "event", "place", "food", "pet", "vehicle", "nature", "screenshot", "receipt", "document")
UNSEEN_LABELS = ("screenshot", "receipt", "document")

RAW_ITEM = _struct("id:s source:s ts:t sender:s text:s media_path:s is_system:b meta:s source_group:s seq:l")
EXTRACTED_FACT = _struct("kind:s statement:s subjects:as place:s happened_at:s confidence:d")
FACT = _struct("id:s kind:s body:s statement:s confidence:f happened_at:s entity_ids:as provenance:as valid_at:t invalid_at:t expired_at:t created_at:t updated_at:t hash:s embedding:af")
FACT_HISTORY = _struct("id:l fact_id:s event:s prev:s next:s at:t")
ENTITY = _struct("id:s name:s kind:s aliases:as embedding:af created_at:t")
MERGE_PROPOSAL = _struct("id:s mention:s entity_id:s evidence:s score:f status:s created_at:t")
PROFILE = _struct("id:s body:s fact_count:i created_at:t")
EXTRACTED_WINDOW = _struct("window_hash:s outcome:s created_at:t")
MERGE_VERDICT = _struct("same:b confidence:d reason:s")
PHOTO_FACTS = _struct("scene:s activity:s people_count:i notable:as")
BBOX = _struct("x1:f y1:f x2:f y2:f")
FACE_HIT = _struct("path:s bbox:box embedding:af", box=BBOX)
VISION_TAGS = MapType(StringType(), FloatType())
EXTRACTION_RESULT = _struct("facts:facts notes:s", facts=ArrayType(EXTRACTED_FACT))

#: The columns that readers of facts get; the embedding and the body stay behind.
FACT_COLUMNS = ("id", "kind", "statement", "confidence", "happened_at", "entity_ids", "provenance", "valid_at", "invalid_at")
