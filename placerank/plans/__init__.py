from .batch import recommend_batch
from .clean import clean_business, clean_checkin, clean_review, clean_tip, clean_user
from .single import Query, recommend, recommend_json
