"""Schemas of the nested tables as DDL text; triples are structs and fields are read by name."""

from __future__ import annotations

TRIPLE = "struct<head:string,relation:string,tail:string>"
SCORED_TRIPLE = "struct<head:string,relation:string,tail:string,hop:int,score:double>"


RAW_SAMPLE = "id string, question string, graph array<struct<h:string,r:string,t:string>>, q_entity array<string>, a_entity array<string>"
RETRIEVAL_RESULT = f"sample_id string, question string, q_entity array<string>, q_entity_in_graph array<string>, a_entity array<string>, a_entity_in_graph array<string>, max_path_length int, target_relevant_triples array<{TRIPLE}>, scored_triples array<{SCORED_TRIPLE}>"
SUPERVISION = "sample_id string, triplets array<struct<head:string,relation:string,tail:string,label:string>>"
GOLD_PATHS = f"sample_id string, id string, question string, topic_entities array<string>, answer_entities array<string>, paths array<struct<answer_entity:string,path_found:boolean,path_triplets:array<{TRIPLE}>>>"
EVAL_SUBGRAPH = "id string, question string, topic_entities array<string>, triplets array<array<string>>"
PREDICTION = "id string, question string, ground_truth array<string>, prediction string"
CALL_LOG = "request struct<sample_id:string,trajectory_id:string,question:string>, response struct<ok:boolean,reward_metric_value:double>, transmission_diagnostic struct<triple_transmission_diagnosis:string>"
EPISODE_TURN = "episode_id long, turn long, kind string, triple_id int"
MESSAGE = "struct<role:string,content:string,loss_weight:double>"
