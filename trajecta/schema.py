"""Schemas of the engine's tables, as DDL. Arguments of calls are JSON texts."""

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
RAW_MESSAGE = f"struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:{CALLS}>"
MESSAGE = f"struct<role:string,content:string,reasoning:string,tool_call_id:string,name:string,tool_calls:{CALLS}>"

RAW_TRAJECTORY = f"instance_id string, repo string, resolved int, trajectory array<{RAW_MESSAGE}>, model_patch string"
CONVERSATION = f"instance_id string, repo string, issue string, n_turns int, messages array<{MESSAGE}>"
PATCH = "instance_id string, resolved int, model_patch string"
TOOLS = "array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>"
BODY = f"struct<model:string,messages:array<{MESSAGE}>,tools:{TOOLS},temperature:double,top_p:double,top_k:int,max_tokens:int,max_completion_tokens:int,thinking_token_budget:int,chat_template_kwargs:struct<enable_thinking:boolean>>"
REQUEST_LOG = f"t double, status int, body {BODY}, raw string, error string"
SUMMARY_LOG = "t double, dt double, status int, model string, n_messages int, enable_thinking boolean, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, finish string, error string"
RESULT = "arm string, id string, repo string, resolved boolean, started_at double, ended_at double, wall_s double, tool_calls int, status string, error string, patch_chars int"
WINDOW = "segments array<struct<text:string,train:int>>, instance_id string, turns int"
SMOKE = "role string, system_head string, tools array<string>, enable_thinking boolean, thinking_token_budget int, max_tokens int, temperature double, top_k int, tool_result_roles array<string>, last_tool_result string, last_tool_encoding string"
