"""Business vocabularies that results depend on.

Every block below is a list of fixed values, one per line, stated as they must
match. They are the cleaned image of the raw text (UTF-8 names mis-read as
latin-1 included), so they must not be "repaired". All operators take these as
parameters and accept other vocabularies in their place.
"""

from __future__ import annotations


def _lines(block: str) -> tuple[str, ...]:
    return tuple(line.strip() for line in block.strip().splitlines())


def _pairs(block: str) -> dict[str, str]:
    return dict(tuple(part.strip() for part in line.split(" -> ")) for line in _lines(block))


# --- neighbourhood names: not a place -------------------------------------------
INVALID_UNITS = _lines("""
bairro ficticio
bairro nao informado
bairro nao localizad
indicacoes cancelada
nao encontrado
nao informado
nf
ni
sem dados
""")

# --- neighbourhood names: outside the municipality -------------------------------
METROPOLITAN_UNITS = _lines("""
bairro oliveira
barro preto
belas aguas
borda do campo
braga
campinha grande do s
campo de sao benedit
campo pequeno
canguiri
colombo
colonia faria
colonia sao venancio
estados
estancia pinhais
eucaliptos
formoso
gralha azul
guatupe
iguacu 01
iguacu 1
ipe 2
jardim boa vista
jardim bom pastor
jardim loanda
jardim osasco
jardim pedro demete
jardim rafaela
jardim santa monica
jardim weissopolis
jd dona belizaria
jd europa
jd orestes tha
jd suissa
jr taisa
lot marinoni
loteamento sao geron
maria antonieta
maua
menino deus
nacoes
osasco
ouro fino
palmeirinha
parque da fonte
parque das fontes
parque das nascentes
pineville
pinhais
piraquara
planta deodoro
planta meireles
quatro barras
rainha
rio verde
roca grande
roca negra
santa monica
santa teresinha
santa terezinha
santo antonio
sao benedito
sao geronimo
sao jose
sao jose dos pinhais
tamandare
thomas coelho
thomaz coelho
veneza
vila graziela
vila ipanema
vila maria antonieta
casa
""")

# --- neighbourhood names: typo or alias -> official -------------------------------
UNIT_FIXES = _pairs("""
ahao -> ahu
alto da gla3ria -> alto da gloria
alto da rua xv -> alto da xv
barigua -> barigui
capanema -> jardim botanico
campo de santana -> campo do santana
centro cavico -> centro civico
cic -> cidade industrial
cidade industrial de -> cidade industrial
francisco gorski -> cidade industrial
guaara -> guaira
higiena3polis -> higienopolis
jardim das amaricas -> jardim das americas
jardim industrial -> cidade industrial
juvevaa -> juveve
linda3ia -> lindoia
monte rey -> boqueirao
mercaas -> merces
mossunguaa -> mossungue
passaaona -> passauna
pca espanha -> bigorrilho
rebouaas -> reboucas
santa quitaria -> santa quiteria
satio cercado -> sitio cercado
sit cercado -> sitio cercado
sao lourenao -> sao lourenco
sao cristovao -> santa felicidade
sao braz -> sao braz
sao joao -> sao joao
sao jorge -> portao
sao judas tadeu -> capao raso
sao pedro -> xaxim
sao sebastiao -> ahu
sao thomas -> seminario
sao thomaz -> seminario
sitio das palmeiras -> bacacheri
tindiquera -> bairro alto
vila bancaria -> campo largo
vila formosa -> portao
""")

# --- neighbourhood names: official list -------------------------------------------
OFFICIAL_UNITS = _lines("""
centro
sao francisco
centro civico
alto da gloria
alto da xv
cristo rei
jardim botanico
reboucas
agua verde
batel
bigorrilho
merces
bom retiro
ahu
juveve
cabral
hugo lange
jardim social
taruma
capao da imbuia
cajuru
jardim das americas
guabirotuba
prado velho
parolin
guaira
portao
vila izabel
seminario
campina do siqueira
vista alegre
pilarzinho
sao lourenco
boa vista
bacacheri
bairro alto
uberaba
hauer
fanny
lindoia
novo mundo
fazendinha
santa quiteria
campo comprido
mossungue
santo inacio
cascatinha
sao joao
taboao
abranches
cachoeira
barreirinha
santa candida
tingui
atuba
boqueirao
xaxim
capao raso
orleans
sao braz
butiatuvinha
lamenha pequena
santa felicidade
alto boqueirao
sitio cercado
pinheirinho
sao miguel
augusta
riviera
caximba
campo do santana
ganchinho
umbara
tatuquara
cidade industrial
""")

# --- census and map name fixes ----------------------------------------------------
CENSUS_2010_UNIT_FIXES = _pairs("""
botiatuvinha -> butiatuvinha
cidade industrial de curitiba -> cidade industrial
alto da rua xv -> alto da xv
campo de santana -> campo do santana
""")
CENSUS_2022_UNIT_FIXES = _pairs("""
botiatuvinha -> butiatuvinha
cidade industrial de curitiba -> cidade industrial
""")
MAP_UNIT_ALIASES = _pairs("""
alto da rua xv -> alto da xv
campo de santana -> campo do santana
cidade industrial de curitiba -> cidade industrial
""")

# --- incident natures: typo -> canonical ------------------------------------------
NATURE_FIXES = _pairs("""
abito -> obito
agressao fasica verbal -> agressao fisica verbal
ameaaa -> ameaca
apropriaaao indabita -> apropriacao indebita
argaos acionados -> orgaos acionados
atitude suspeita abordagem -> atitude suspeita
avaria em equipamento patrima nio nao intencional -> avaria em equipamento patrimonio nao intencional
averiguaaao comarcio ilegal -> averiguacao comercio ilegal
averiguaaao cosedi -> averiguacao cosedi
averiguaaao defesa civil -> averiguacao defesa civil
banho em local impra3prio -> banho em local improprio
calaonia -> calunia
comarcio ambulante -> comercio ambulante
construaao irregular -> construcao irregular
corrupaao de menores -> corrupcao de menores
crianaa perdida desaparecida -> crianca perdida desaparecida
denaoncia de bomba -> denuncia de bomba
depa3sito irregular -> deposito irregular
desinteligaancia -> desinteligencia
deslizamenton de terra -> deslizamento de terra
desobediaancia -> desobediencia
devoluaao de coisa achada -> devolucao de coisa achada
difamaaao -> difamacao
discriminaaao -> discriminacao
distaorbio -> disturbio
exploraaao de menores -> exploracao de menores
extravio sonegaaao ou inutilizaaao de livro ou doc -> extravio sonegacao ou inutilizacao de livro ou doc
falsidade ideola3gica falsa identidade -> falsidade ideologica falsa identidade
fiscalizaaaes e orientaaaes -> fiscalizacoes e orientacoes
fornecimento de bebida alcoa3lica a menores -> fornecimento de bebida alcoolica a menores
homicadio -> homicidio
impedimento ou perturbaaao de cerima nia funeraria -> impedimento ou perturbacao de cerimonia funeraria
importunaaao ofensiva ao pudor -> importunacao ofensiva ao pudor
importunaaaoa sexual -> importunacao sexual
incaandio -> incendio
incendio explosao em edificaaao -> incendio explosao em edificacao
infiltraaao -> infiltracao
injaoria -> injuria
inundaaao enchente -> inundacao enchente
manifestaaao -> manifestacao
manipulaaao de explosivo -> manipulacao de explosivo
notificaaao -> notificacao
obstruaao da atividade policial -> obstrucao da atividade policial
ocupaaao irregular -> ocupacao irregular
orientaaao -> orientacao
perseguiaao stalking -> perseguicao stalking
perturbaaao do sossego -> perturbacao do sossego
poluiaao visual ambiental -> poluicao visual ambiental
prevaricaaao -> prevaricacao
proteaao ao patrima nio -> protecao ao patrimonio
quedas de objetos ou partes de construaaes -> quedas de objetos ou partes de construcoes
queima a cau aberto -> queima a ceu aberto
rachadura em edificaaao -> rachadura em edificacao
receptaaao -> receptacao
resistaancia -> resistencia
roubo furto extravio recuperaaao apreensao de armas de fogo -> roubo furto extravio recuperacao apreensao de armas de fogo
seqa14estro e carcere privado -> sequestro e carcere privado
situaaao de risco -> situacao de risco
substancia ilacita -> substancia ilicita
substancia lacita -> substancia licita
suicadio -> suicidio
tentativa de homicadio -> tentativa de homicidio
veaculo -> veiculo
venda proibida de produtos especaficos a menores -> venda proibida de produtos especificos a menores
verificaaao -> verificacao
violaaao de medida protetiva lei maria da penha -> violacao de medida protetiva lei maria da penha
violaaao de sepultura taomulo -> violacao de sepultura tumulo
violaancia arbitraria -> violencia arbitraria
escrito ou objeto obsceno panfletos pornograficos -> panfletagem pornografica
""")

# --- incident natures: too vague, the row is dropped -------------------------------
UNDETERMINED_NATURES = ("tentativa",)

# --- incident natures by category (category name is the output column) -------------
NATURE_CATEGORIES: dict[str, tuple[str, ...]] = {
    "CRIME_VIOLENTO": _lines("""
abandono de incapaz
abuso de incapazes
agressao fisica verbal
ameaca
arrastao
atentado violento ao pudor
constrangimento ilegal
disparo de arma
estupro
extorsao
homicidio
importunacao ofensiva ao pudor
importunacao sexual
lesao corporal
maus tratos a pessoas
omissao de socorro
perseguicao stalking
posse sexual mediante fraude
resistencia
rixa
roubo
sequestro e carcere privado
tentativa de homicidio
vias de fato
violacao de medida protetiva lei maria da penha
violencia arbitraria
roubo furto extravio recuperacao apreensao de armas de fogo
"""),
    "ATENDIMENTO_OPERACIONAL_ASSISTENCIAL": _lines("""
aifu
alarmes
antecedentes criminais verificacao
apoio
atitude suspeita
averiguacao
averiguacao cosedi
averiguacao defesa civil
denuncia improcedente
encaminhamento
envenenamento
escolta
evento
fiscalizacoes e orientacoes
fundada suspeita abordagem
abordagem
verificacao
vistoria
voo drone gmc
zeladoria urbana
liberacao de pessoa presa apreendida por recusa no recebimento pela dp
notificacao
obito
obito defesa civil
orgaos acionados
orientacao
paciente usuario alterado
patrulha maria da penha
protecao ao patrimonio
ronda
saturacao
suicidio
"""),
    "ACIDENTE_TRANSITO": _lines("""
acidente de transito
acidente viatura
transito
queda de aeronave
veiculo
"""),
    "ACIDENTE_NATURAL": _lines("""
abalo sismico
alagamento
animais
ataque cao feroz
ataque de insetos
bueiro aberto sem tampa
bueiro entupido
deslizamento de terra
enxurrada
erosao
inundacao enchente
pragas animais
poda de arvore
poluicao visual ambiental
queda de arvore
queda de galho
risco de queda de arvore
risco de queda de galho
rompimento de barragem
"""),
    "CRIME_PATRIMONIAL": _lines("""
apropriacao indebita
calote
dano
estelionato
furto
invasao
receptacao
retirada de invasao
"""),
    "CRIME_ADMINISTRACAO_PUBLICA": _lines("""
abandono de funcao
contrabando ou descaminho
concussao
corrupcao ativa
desacato
desobediencia
fingir se funcionario publico
obstrucao da atividade policial
peculato
prevaricacao
recusar se identificar ao policial
tentativa de suborno
usar de uniforme ou distintivo de funcao publica que nao exerce
"""),
    "CRIME_HONRA_DISCRIMINACAO": _lines("""
calunia
difamacao
discriminacao
homofobia
injuria
racismo
"""),
    "CRIME_CRIANCA_ADOLESCENTE": _lines("""
aliciamento de menor
corrupcao de menores
exploracao de menores
fornecimento de bebida alcoolica a menores
fuga de aluno interno
menor gazeando aula
menores abordando transeuntes
seducao
venda proibida de produtos especificos a menores
"""),
    "CRIME_FRAUDE_DOCUMENTAL": _lines("""
extravio sonegacao ou inutilizacao de livro ou doc
falsidade ideologica falsa identidade
falsificacao de documento publico
moeda falsa
uso indevido do cartao transporte
uso indevido do telefone publico
"""),
    "CRIME_DROGAS_SUBSTANCIAS": _lines("""
embriaguez
substancia ilicita
substancia licita
"""),
    "CRIME_ORDEM_PUBLICA": _lines("""
apologia de crime ou criminoso
aterro irregular
atos obscenos libidinosos
averiguacao comercio ilegal
crime ambiental
comercio ambulante
conduta inconveniente
construcao irregular
corte irregular de arvore
deposito irregular
descumprimento lei 15799 2021 covid 19
desinteligencia
disturbio
favorecimento da prostituicao
impedimento ou perturbacao de cerimonia funeraria
incitacao ao crime
charlatanismo
jogo de azar
maus tratos a animais
mendigar por ociosidade ou cupidez
manifestacao
obstrucao de via
ocupacao irregular
panfletagem pornografica
pesca em local proibido
perturbacao do sossego
porte ilegal
prostituicao
quadrilha ou bando
rufianismo
trote telefonico
vadiagem
vilipendio a cadaver
violacao de sepultura tumulo
banho em local improprio
voo drone irregular
"""),
    "RISCO_ESTRUTURAL": _lines("""
afundamento de piso
desabamento
desabamento de telhado cobertura
infiltracao
queda de fios de energia
queda de muro
queda de poste
queda de revestimento de fachadas
quedas de objetos ou partes de construcoes
rachadura em edificacao
risco de acidente a vida
risco de acidente a vida defesa civil
risco de desabamento desmoronamento
risco de queda de fios de energia
risco de queda de poste
situacao de risco
destelhamento
"""),
    "EXPLOSIVOS_E_PRODUTOS_PERIOGOSOS": _lines("""
denuncia de bomba
explosao
incendio
incendio explosao em edificacao
manipulacao de explosivo
porte de artefato explosivo
queima a ceu aberto
risco de explosao
vazamento ou derramamento de produto perigoso ou infectante
"""),
    "PESSOAS_DESAPARECIDAS": _lines("""
afogamento
crianca perdida desaparecida
desaparecimento
fuga de paciente
"""),
    "MATERIAIS_OBJETOS": _lines("""
achado
apreensao de materiais
avaria em equipamento patrimonio nao intencional
camera off line
cameras de videomonitoramento
devolucao de coisa achada
extravio de documento
extravio de equipamento
fornecimento de lona
material abandonado
recolhimento de materiais
"""),
}

# --- categories forecast one by one, and those pooled into OUTROS -------------------
FORECAST_CATEGORIES = (
    "CRIME_VIOLENTO", "ATENDIMENTO_OPERACIONAL_ASSISTENCIAL", "ACIDENTE_TRANSITO",
    "CRIME_PATRIMONIAL", "CRIME_DROGAS_SUBSTANCIAS", "CRIME_ORDEM_PUBLICA",
)
POOLED_CATEGORIES = (
    "ACIDENTE_NATURAL", "RISCO_ESTRUTURAL", "EXPLOSIVOS_E_PRODUTOS_PERIOGOSOS", "MATERIAIS_OBJETOS",
    "CRIME_ADMINISTRACAO_PUBLICA", "PESSOAS_DESAPARECIDAS", "CRIME_FRAUDE_DOCUMENTAL",
    "CRIME_CRIANCA_ADOLESCENTE", "CRIME_HONRA_DISCRIMINACAO",
)
ANALYSED_CATEGORIES = ("CRIME_VIOLENTO", "CRIME_DROGAS_SUBSTANCIAS", "CRIME_PATRIMONIAL", "CRIME_ORDEM_PUBLICA")

# --- incident column roles ----------------------------------------------------------
DROP_COLUMNS = (
    "OCORRENCIA_CODIGO", "REGIONAL_FATO_NOME", "SECRETARIA_NOME", "SITUACAO_EQUIPE_DESCRICAO", "OCORRENCIA_DATA",
    "OPERACAO_DESCRICAO", "ORIGEM_CHAMADO_DESCRICAO", "SUBCATEGORIA1_DESCRICAO", "SUBCATEGORIA2_DESCRICAO",
    "SUBCATEGORIA3_DESCRICAO", "SUBCATEGORIA4_DESCRICAO", "SUBCATEGORIA5_DESCRICAO", "EQUIPAMENTO_URBANO_NOME",
)
TEXT_COLUMNS = (
    "ATENDIMENTO_BAIRRO_NOME", "LOGRADOURO_NOME", "NATUREZA1_DESCRICAO", "NATUREZA2_DESCRICAO", "NATUREZA3_DESCRICAO",
    "NATUREZA4_DESCRICAO", "NATUREZA5_DESCRICAO", "SECRETARIA_SIGLA", "SERVICO_NOME", "NUMERO_PROTOCOLO_156",
)
BINARY_COLUMNS = (
    "FLAG_EQUIPAMENTO_URBANO", "FLAG_FLAGRANTE", "NATUREZA1_DEFESA_CIVIL", "NATUREZA2_DEFESA_CIVIL",
    "NATUREZA3_DEFESA_CIVIL", "NATUREZA4_DEFESA_CIVIL", "NATUREZA5_DEFESA_CIVIL",
)
WEEKDAY_COLUMN = "OCORRENCIA_DIA_SEMANA"
HOUR_COLUMN = "OCORRENCIA_HORA"
DATE_COLUMN = "OCORRENCIA_DATA"
CODE_COLUMN = "OCORRENCIA_CODIGO"
UNIT_COLUMN = "ATENDIMENTO_BAIRRO_NOME"
NATURE_COLUMNS = tuple(f"NATUREZA{i}_DESCRICAO" for i in range(1, 6))

# --- census constants ----------------------------------------------------------------
MUNICIPALITY_CODE = "4106902"
MINIMUM_WAGE = {2010: 510, 2022: 1212}
CENSUS_2022_FILES = (
    "Agregados_por_bairros_basico_BR.csv", "Agregados_por_bairros_alfabetizacao_BR.csv",
    "Agregados_por_bairros_renda_responsavel_BR.csv", "Agregados_por_bairros_caracteristicas_domicilio1_BR.csv",
    "Agregados_por_bairros_caracteristicas_domicilio2_BR.csv",
)
